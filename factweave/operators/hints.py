"""Template-driven discovery: rule shapes whose relation symbols stand for any relation.

A hint file has a coverage threshold, a ratio threshold, and lines ``rule;[(p,q),(..)]``.
Upper parts of a restriction may not all stand for the same relation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fingerprint import fingerprint
from ..plans.rule import Rule, Var, parse_rule
from .evaluate import scored
from .kb import KnowledgeBase, union
from .profile import sizes


@dataclass(frozen=True)
class Hint:
    template: Rule
    restrictions: tuple[tuple[str, ...], ...] = ()


def parse_hint(line: str) -> Hint:
    text, _, rest = line.partition(";")
    groups = tuple(tuple(x.strip() for x in g.split(",")) for g in re.findall(r"\(([^()]*)\)", rest))
    return Hint(parse_rule(text), groups)


def parse_hints(text: str) -> tuple[float, float, list[Hint]]:
    """Coverage and ratio thresholds, and the hints."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return float(lines[0]), float(lines[1]), [parse_hint(x) for x in lines[2:]]


def instances(hint: Hint, arities: dict[str, int]) -> Iterator[Rule]:
    """Every assignment of relations of the right arity that the restrictions allow, each rule once."""
    symbols = {a.relation: a.arity for a in hint.template.atoms}
    names, seen = list(symbols), set()

    def go(i: int, chosen: dict[str, str]) -> Iterator[Rule]:
        if any(len(g) > 1 and all(x in chosen for x in g) and len({chosen[x] for x in g}) == 1 for g in hint.restrictions):
            return
        if i == len(names):
            rule = Rule(tuple(replace(a, relation=chosen[a.relation]) for a in hint.template.atoms))
            own = fingerprint(rule)
            if own not in seen and not rule.invalid():
                seen.add(own)
                yield rule
            return
        for r, arity in sorted(arities.items()):
            if arity == symbols[names[i]]:
                yield from go(i + 1, {**chosen, names[i]: r})

    yield from go(0, {})


def _joinable(kb: KnowledgeBase, rules: list[Rule]) -> list[Rule]:
    """The rules each of whose variables stands in columns that meet pairwise; the others entail no fact."""
    columns = F.sort_array(F.collect_set(F.struct("rel", "pos")))
    # the columns that one value stands in; how many such sets there are the catalogue bounds
    sets = kb.domains().groupBy("val").agg(columns.alias("at")).select("at").distinct().collect()
    meet = {(tuple(p), tuple(q)) for r in sets for p in r["at"] for q in r["at"]}

    def fits(rule: Rule) -> bool:
        places = [(x, (a.relation, i)) for a in rule.atoms for i, x in enumerate(a.args) if isinstance(x, Var)]
        return all((p, q) in meet for x, p in places for y, q in places if x == y)

    return [r for r in rules if fits(r)]


def discover(kb: KnowledgeBase, hints: list[Hint], coverage: float, ratio: float, batch: int = 24) -> DataFrame:
    """``rule, length, pos, neg, coverage_percent, tau, delta`` of the instances that reach both thresholds, best ratio first."""
    rules = [r for h in hints for r in instances(h, kb.arities)]
    rules = _joinable(kb, rules) if rules and coverage >= 0 else rules
    schema = "rule string, length double, pos double, neg double, coverage_percent double, tau double, delta double"
    if not rules:
        return kb.spark.createDataFrame([], schema)
    parts = []
    for i in range(0, len(rules), batch):
        some = rules[i : i + batch]
        heads = kb.spark.createDataFrame([(str(r), r.head.relation) for r in some], "rule string, rel string").distinct()
        parts.append(scored(kb, some).distinct().join(F.broadcast(heads), "rule"))  # a batch of rules
    found = union(parts).join(F.broadcast(sizes(kb).select("rel", "total")), "rel").withColumn("coverage_percent", 100 * F.col("pos") / F.col("total"))
    found = found.filter((F.col("coverage_percent") > 100 * coverage) & (F.col("tau") >= ratio))
    return found.select("rule", "length", "pos", (F.col("all") - F.col("pos")).alias("neg"), "coverage_percent", "tau", "delta").orderBy(F.desc("tau"), "rule")
