"""What an accepted rule yields: counterexamples, witnesses and dependency edges.

A fact stands in a graph as a string of its relation and arguments; see :func:`node`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import pairs
from ..plans.compile import RulePlan
from ..plans.rule import Rule
from . import graph
from .evaluate import as_rule
from .grouped import Grouped
from .kb import KnowledgeBase, columns, cut_lineage, union


def node(relation: str, args: Column) -> Column:
    """A fact as text: JSON of relation and arguments, so that different facts differ."""
    return F.to_json(F.struct(F.lit(relation).alias("rel"), args.alias("args")))


def counterexamples(kb: KnowledgeBase, rule: Rule | str, symbols: DataFrame | None = None) -> DataFrame:
    return RulePlan(kb, as_rule(rule)).counterexamples(symbols)


def evidence(kb: KnowledgeBase, rule: Rule | str) -> DataFrame:
    """Newly entailed head facts with one witness: head columns and ``b0 ..``, the least body facts."""
    return RulePlan(kb, as_rule(rule)).grounded()


def edges_of(rule: Rule | str, found: DataFrame, towards: set[str] | None = None) -> DataFrame:
    """``src, dst`` from each head fact to the body facts of its witness, or to those in relations ``towards``; rules without such give none.

    Each head fact is found once, so an edge is, too.
    """
    r = as_rule(rule)
    head = node(r.head.relation, F.array(*columns(r.head.arity)))
    ends = [(i, a.relation) for i, a in enumerate(r.body) if towards is None or a.relation in towards]
    if not ends:
        return found.select(head.alias("src"), head.alias("dst")).limit(0)
    bodies = F.array(*(node(relation, F.col(f"b{i}")) for i, relation in ends))
    return found.select(head.alias("src"), F.explode(F.array_distinct(bodies)).alias("dst"))


def edge_count(rule: Rule, found: DataFrame) -> DataFrame:
    """One row, ``n``: the edges of :func:`edges_of`, without their texts."""
    bodies = F.array(*(F.struct(F.lit(a.relation).alias("rel"), F.col(f"b{i}").alias("args")) for i, a in enumerate(rule.body)))
    return found.agg(F.coalesce(F.sum(F.size(F.array_distinct(bodies))), F.lit(0)).cast("long").alias("n"))


def cyclic_edges(taken: list[tuple[Rule, DataFrame]]) -> DataFrame | None:
    """Of the edges of rules, with what each found, those within relations that rest on each other: no others can be on a cycle."""
    rests: dict[str, set[str]] = {}
    for r, _ in taken:
        rests.setdefault(r.head.relation, set()).update(a.relation for a in r.body)
    own = {n: part for part in graph.tarjan(rests) for n in part}
    parts = [edges_of(r, found, own[r.head.relation]) for r, found in taken if own.get(r.head.relation, set()) & {a.relation for a in r.body}]
    return union(parts) if parts else None


@dataclass
class Mirror:
    """What ``p(X,Y):-p(Y,X)`` entails of a relation that is kept by groups: each fact rests on its exchange and on nothing else.

    No other edge leads out of these facts, so whatever else leads to them, a fact and its exchange are a
    component, and the lesser of the two a feedback set of it.
    """

    relation: str
    facts: Grouped

    def _node(self, *args: str) -> Column:
        return node(self.relation, F.array(*args))

    def edges(self) -> DataFrame:
        return self.facts.pairs().select(self._node("c0", "c1").alias("src"), self._node("c1", "c0").alias("dst"))

    def nodes(self) -> DataFrame:
        """``id``; each once."""
        return self.facts.pairs().select(self._node("c0", "c1").alias("id"))

    def components(self) -> DataFrame:
        return self.edges().select(F.col("src").alias("node"), F.least("src", "dst").alias("component"))

    def chosen(self) -> DataFrame:
        return self.facts.lesser().select(self._node("c0", "c1").alias("node")).withColumn("component", F.col("node"))

    def other(self, nodes: DataFrame) -> DataFrame:
        """Those of the nodes (``id``) that are none of these facts."""
        fact = F.from_json("id", "struct<rel string, args array<string>>")
        read = nodes.withColumn("_f", fact)
        own = read.filter((F.col("_f.rel") == self.relation) & (F.size("_f.args") == 2)).select("id", F.col("_f.args")[0].alias("c0"), F.col("_f.args")[1].alias("c1"))
        return nodes.join(self.facts.holding(own, "c0", "c1").select("id"), "id", "left_anti")


@dataclass
class Dependencies:
    """Edges between facts: as a table, and as relations of which each fact rests on its exchange."""

    plain: DataFrame | None = None
    mirrors: list[Mirror] = field(default_factory=list)
    cyclic: DataFrame | None = None  # those of the table that may be on a cycle

    def _all(self, plain: DataFrame | None, parts: list[DataFrame]) -> DataFrame | None:
        found = [*([] if plain is None else [plain]), *parts]
        return union(found) if found else None

    def edges(self) -> DataFrame | None:
        """``src, dst``."""
        return self._all(self.plain, [m.edges() for m in self.mirrors])

    def nodes(self) -> DataFrame | None:
        """``id``: the ends of all edges, each once."""
        ends = None if self.plain is None else self.plain.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        for m in self.mirrors if ends is not None else ():
            ends = m.other(ends)
        return self._all(ends, [m.nodes() for m in self.mirrors])

    def components(self) -> DataFrame | None:
        """See :func:`graph.components`; edges of the table that lead to a mirror's facts do not come back from there."""
        return self._all(None if self.cyclic is None else graph.components(self.cyclic), [m.components() for m in self.mirrors])

    def feedback(self, plain: DataFrame | None) -> DataFrame | None:
        """``node, component``, with what was chosen for the table."""
        return self._all(plain, [m.chosen() for m in self.mirrors])

    def written(self) -> Dependencies:
        """With what may be on a cycle in the shared folder and small tables for the groups of mirrors."""
        return Dependencies(self.plain, [Mirror(m.relation, m.facts.written()) for m in self.mirrors], None if self.cyclic is None else cut_lineage(self.cyclic))


def dependencies(kb: KnowledgeBase, rules: list[Rule | str]) -> Dependencies:
    """Edges of several rules in turn, each marking what it entails before the next."""
    taken, mirrors = [], []
    for r in map(as_rule, rules):
        if (facts := pairs.mirror(RulePlan(kb, r))) is not None:
            mirrors.append(Mirror(r.head.relation, facts))
            kb.mark_groups(r.head.relation, facts)
            continue
        found = evidence(kb, r)
        taken.append((r, found))
        kb.mark(r.head.relation, found.select(*columns(r.head.arity)))
    # a fact is newly entailed by one rule only, so no edge is there twice
    return Dependencies(union(edges_of(*t) for t in taken) if taken else None, mirrors, cyclic_edges(taken))


def dependency_edges(kb: KnowledgeBase, rules: list[Rule | str]) -> DataFrame:
    """The same as one table ``src, dst``."""
    return dependencies(kb, rules).edges()
