"""Rules compiled to DataFrames.

For ``h(..) :- b1(..), .., bm(..)`` let V be the head's variables that the body has.  The
body becomes the different bindings of V; each atom is cut to the variables that are still
needed, without duplicates, before and after it is joined, so that columns which nobody asks
for never multiply rows.  Atoms are joined along shared variables; an atom without any is a
test for existence.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kb import KnowledgeBase, columns
from .rule import Atom, Const, Rule, Var


#: Tuples that a rule with free places in its head may be asked to write out.
MOST_TUPLES = 10**11


#: Head and atoms whose joins are ordered by what they make; the joins of longer rules follow the rule.
MOST_ORDERED = 6


class TooManyTuples(ValueError):
    """A rule with free places entails more tuples than anybody should write out."""


def name_of(var: Var) -> str:
    return f"v{var.id}"


def conditions(atom: Atom) -> list[Column]:
    """What the constants and repeated variables of an atom ask of its relation."""
    out: list[Column] = []
    first: dict[Var, int] = {}
    for i, a in enumerate(atom.args):
        if isinstance(a, Const):
            out.append(F.col(f"c{i}") == F.lit(a.value))
        elif isinstance(a, Var):
            if a in first:
                out.append(F.col(f"c{i}") == F.col(f"c{first[a]}"))
            first.setdefault(a, i)
    return out


def selected(kb: KnowledgeBase, atom: Atom, frame: DataFrame | None = None) -> DataFrame:
    """The relation's rows that fit the atom."""
    df = kb[atom.relation] if frame is None else frame
    if kb.arity(atom.relation) != atom.arity:
        raise ValueError(f"{atom.relation} has arity {kb.arity(atom.relation)}, not {atom.arity}")
    for c in conditions(atom):
        df = df.filter(c)
    return df


def bindings(kb: KnowledgeBase, atom: Atom, needed: set[Var], frame: DataFrame | None = None) -> DataFrame:
    """The different values of the atom's needed variables; one column ``one`` if there are none."""
    if frame is None and atom.relation in kb.grouped and len(atom.variables()) == 1 and set(atom.args) == {None, *atom.variables()} and set(atom.variables()) <= needed:
        v = atom.variables()[0]
        return kb.grouped[atom.relation].values().filter(F.col("pos") == atom.args.index(v)).select(F.col("val").alias(name_of(v)))
    df = selected(kb, atom, frame)
    kept = [F.col(f"c{atom.args.index(v)}").alias(name_of(v)) for v in atom.variables() if v in needed]
    if not kept:
        return df.select(F.lit(1).alias("one")).limit(1)
    out = df.select(*kept)
    # a projection to all columns of a set has no duplicates
    return out if None not in atom.args and len(kept) == atom.arity else out.distinct()


def ordered(atoms: list[Atom]) -> list[int]:
    """An order in which each atom shares a variable with an earlier one, as far as possible."""
    left, seen, out = list(range(len(atoms))), set(), []
    while left:
        best = max(left, key=lambda i: (bool(set(atoms[i].variables()) & seen), sum(isinstance(a, Const) for a in atoms[i].args), -i))
        left.remove(best)
        out.append(best)
        seen |= set(atoms[best].variables())
    return out


def connected(body: tuple[Atom, ...]) -> list[tuple[int, ...]]:
    """Numbers of the atoms of each part of a body; atoms that share a variable are in one part."""
    parts: list[tuple[set[Var], list[int]]] = []
    for i, atom in enumerate(body):
        own = set(atom.variables())
        near = [p for p in parts if p[0] & own]
        parts = [p for p in parts if not p[0] & own] + [(own.union(*(v for v, _ in near)), sorted([i, *(j for _, at in near for j in at)]))]
    return sorted(tuple(at) for _, at in parts)


def body_bindings(kb: KnowledgeBase, body: tuple[Atom, ...], wanted: list[Var], frames: dict[int, DataFrame] | None = None) -> DataFrame:
    """The different bindings of ``wanted`` in a join of the atoms; ``frames`` replaces relations by atom.

    Without wanted variables the result has a row (column ``one``) if the body holds anywhere.
    """
    if not frames and any(a.relation in kb.grouped for a in body):
        from . import pairs

        if (found := pairs.hopped(kb, body, wanted)) is not None:
            return found
        if len(wanted) == 2 and (groups := pairs.bound_by_groups(kb, body, *wanted)) is not None:
            return groups.pairs().toDF(*map(name_of, wanted))
    frames, atoms, target = frames or {}, list(body), set(wanted)
    order = ordered(atoms)
    now: DataFrame | None = None
    have: set[Var] = set()
    tests: list[DataFrame] = []
    for n, i in enumerate(order):
        later = {v for j in order[n + 1 :] for v in atoms[j].variables()}
        own = set(atoms[i].variables())
        need = own & (have | later | target)
        part = bindings(kb, atoms[i], need, frames.get(i))
        if not need:
            tests.append(part)
            continue
        shared = sorted(need & have)
        if now is None:
            now = part
        elif shared:
            now = now.join(part, [name_of(v) for v in shared], "left_semi" if need <= have else "inner")
        elif target & need or later & need:
            now = now.crossJoin(part)
        have |= need
        kept = have & (later | target)
        if kept and kept != have:
            now = now.select(*(name_of(v) for v in sorted(kept))).distinct()
        elif not kept:
            tests.append(now.select(F.lit(1).alias("one")).limit(1))
            now = None
        have = kept
    if now is None:
        now = kb.spark.range(1).select(F.lit(1).alias("one")) if not tests else tests.pop()
        if wanted:
            raise ValueError("a wanted variable is not in the body")
    for t in tests:  # at most one row each
        now = now.join(F.broadcast(t.withColumnRenamed("one", "_one")), F.lit(True), "left_semi")
    return now.select(*(name_of(v) for v in wanted)).distinct() if wanted else now


@dataclass
class RulePlan:
    """The parts of a rule's evaluation."""

    kb: KnowledgeBase
    rule: Rule

    @property
    def shared(self) -> list[Var]:
        """Head variables that the body has."""
        in_body = {v for a in self.rule.body for v in a.variables()}
        return [v for v in self.rule.head.variables() if v in in_body]

    @property
    def free(self) -> int:
        """Head places and variables that take every symbol."""
        only = set(self.rule.head.variables()) - set(self.shared)
        return sum(a is None for a in self.rule.head.args) + len(only)

    def body(self, frames: dict[int, DataFrame] | None = None) -> DataFrame:
        return body_bindings(self.kb, self.rule.body, self.shared, frames)

    def parts(self) -> list[tuple[DataFrame, list[Var]]]:
        """The different bindings of each part of the body with the head variables that they bind.

        Parts have no variable in common, so the body's bindings are their product, which is never made to count it.
        """
        out = []
        for at in connected(self.rule.body):
            atoms = tuple(self.rule.body[i] for i in at)
            own = {v for a in atoms for v in a.variables()}
            shared = [v for v in self.shared if v in own]
            out.append((body_bindings(self.kb, atoms, shared), shared))
        return out

    def positives(self, frame: DataFrame | None = None) -> DataFrame:
        """Facts of the head's relation that the rule entails."""
        head = selected(self.kb, self.rule.head, frame)
        for part, shared in self.parts():
            if shared:
                head = head.join(part, [F.col(f"c{self.rule.head.args.index(v)}") == F.col(name_of(v)) for v in shared], "left_semi")
            else:
                head = head.join(F.broadcast(part.limit(1).withColumnRenamed("one", "_one")), F.lit(True), "left_semi")
        return head

    def derived(self, symbols: DataFrame | None = None, frames: dict[int, DataFrame] | None = None) -> DataFrame:
        """All head tuples that the rule entails, with every symbol in the free places.

        Its size is that of the body times a power of the number of symbols; callers
        materialise it for accepted rules only, which entail more facts than they miss.
        Given rules may entail more: beyond MOST_TUPLES that is an error, found by counting first.
        """
        out = self.body(frames)
        symbols = self.kb.constants() if symbols is None else symbols
        if self.free:
            n = out.agg(F.count("*").alias("bodies")).crossJoin(symbols.agg(F.count("*").alias("symbols"))).first()  # one row each
            if n["bodies"] * power(n["symbols"], self.free) > MOST_TUPLES:
                raise TooManyTuples(f"{self.rule} entails {n['bodies']} * {n['symbols']}^{self.free} tuples")
        shared, extra, only = self.shared, [], {}
        for i, a in enumerate(self.rule.head.args):
            if a is None:
                extra.append(f"free{i}")
            elif isinstance(a, Var) and a not in shared and a not in only:
                only[a] = f"free{i}"
                extra.append(f"free{i}")
        for name in extra:
            out = out.crossJoin(symbols.select(F.col("val").alias(name)))
        of = lambda i, a: F.lit(a.value) if isinstance(a, Const) else F.col(f"free{i}") if a is None else F.col(name_of(a)) if a in shared else F.col(only[a])
        return out.select(*(of(i, a).cast("string").alias(f"c{i}") for i, a in enumerate(self.rule.head.args))).distinct()

    def counterexamples(self, symbols: DataFrame | None = None) -> DataFrame:
        """Entailed tuples that are no facts."""
        from . import pairs

        if (found := pairs.derived_groups(self)) is not None:
            return found.minus(self.kb.groups_of(self.rule.head.relation)).written().pairs()
        on = columns(self.rule.head.arity)
        return self.derived(symbols).join(self.kb[self.rule.head.relation], on, "left_anti")

    def counts(self) -> DataFrame:
        """One row: ``new`` and ``old`` (entailed facts, not yet and already entailed), ``bodies`` (a double: it may be a huge product)."""
        from . import pairs

        if pairs.touches(self):
            return self._counts_by_groups()
        out = self.positives(self.kb.marked(self.rule.head.relation)).agg(F.count_if(~F.col("is_old")).alias("new"), F.count_if("is_old").alias("old"))
        names = []
        for i, (part, _) in enumerate(self.parts()):
            names.append(f"_n{i}")
            out = out.crossJoin(part.agg(F.count("*").cast("double").alias(f"_n{i}")))  # one row each
        product = F.lit(1.0)
        for n in names:
            product = product * F.col(n)
        return out.select("new", "old", product.alias("bodies"))

    def _counts_by_groups(self) -> DataFrame:
        """The same for a head that is kept by groups; facts that were entailed before are counted among those that are entailed now."""
        from . import pairs

        parts, name = pairs.bound(self), self.rule.head.relation
        facts = pairs.entailed_facts(self, parts)
        old = self.kb.entailed.get(name)
        if name in self.kb.where:
            before = (facts.pairs() if isinstance(facts, pairs.Grouped) else facts).filter(self.kb.where[name]).agg(F.count("*").alias("_old"))
        elif old is None:
            before = self.kb.spark.range(1).select(F.lit(0).cast("long").alias("_old"))
        elif name in self.kb.marks and self.kb.marks[name][1] is None and isinstance(facts, pairs.Grouped):
            before = facts.met(self.kb.marks[name][0]).count().withColumnRenamed("n", "_old")
        else:
            now = facts.holding(old, "c0", "c1") if isinstance(facts, pairs.Grouped) else old.join(facts, columns(2), "left_semi")
            before = now.agg(F.count("*").alias("_old"))
        out, product = pairs.number(facts).crossJoin(before), F.lit(1.0)  # one row each
        for i, p in enumerate(parts):
            out = out.crossJoin(p.count().select(F.col("n").cast("double").alias(f"_n{i}")))
            product = product * F.col(f"_n{i}")
        return out.select((F.col("n") - F.col("_old")).alias("new"), F.col("_old").alias("old"), product.alias("bodies"))

    def covered(self) -> DataFrame:
        """One row, ``covered``: facts that the rule newly entails."""
        from . import pairs

        if pairs.touches(self):
            return self._counts_by_groups().select(F.col("new").alias("covered"))
        return self.positives(self.kb.not_entailed(self.rule.head.relation)).agg(F.count("*").alias("covered"))

    def grounded(self) -> DataFrame:
        """The least body facts for each newly entailed head fact: head columns and ``b0 .. bm``, arrays of arguments."""
        from . import pairs

        if (found := pairs.single_witness(self)) is not None:
            return found
        head = selected(self.kb, self.rule.head, self.kb.not_entailed(self.rule.head.relation))
        body, heads, own_vars = self.rule.body, columns(self.rule.head.arity), self.rule.head.variables()
        facts = head.select(*heads, *(F.col(f"c{self.rule.head.args.index(v)}").alias(name_of(v)) for v in own_vars))
        order = self._joins(facts)
        own = [set(own_vars) if i is None else set(body[i].variables()) for i in order]
        now, have, taken = None, set(), []
        for n, i in enumerate(order):
            before, later = [*own[:n]], [*own[n + 1 :]]
            # of several facts that bind the same needed variables only the least can be chosen
            needed = sorted(own[n] & set().union(*before, *later))
            if i is None:
                part = facts
            else:
                part = selected(self.kb, body[i]).select(F.array(*columns(body[i].arity)).alias(f"b{i}"), *(F.col(f"c{body[i].args.index(v)}").alias(name_of(v)) for v in needed))
                part = part.groupBy(*map(name_of, needed)).agg(F.min(f"b{i}").alias(f"b{i}")) if needed else part.agg(F.min(f"b{i}").alias(f"b{i}")).filter(F.col(f"b{i}").isNotNull())
                taken = sorted([*taken, i])
            shared = [name_of(v) for v in needed if v in have]
            now = part if now is None else now.join(part, shared) if shared else now.crossJoin(part)
            have |= set(needed)
            kept = have & set().union(*later)
            if None not in order[: n + 1] and kept < have:
                # what is chosen for variables that nothing later shares does not depend on the rest
                have = kept
                least = F.min(F.struct(*(f"b{k}" for k in taken))).alias("w")
                now = (now.groupBy(*(name_of(v) for v in sorted(kept))) if kept else now).agg(least).filter("w IS NOT NULL")
                now = now.select(*(name_of(v) for v in sorted(kept)), *(F.col(f"w.b{k}").alias(f"b{k}") for k in taken))
        names = [f"b{i}" for i in range(len(body))]
        if not names:
            return now.select(*heads)
        return now.groupBy(*heads).agg(F.min(F.struct(*names)).alias("w")).select(*heads, *(F.col(f"w.{n}").alias(n) for n in names))

    def _joins(self, facts: DataFrame) -> list[int | None]:
        """The head (None) and the atoms of the body in the order in which they are joined for witnesses.

        The head comes first where one atom at most is joined to it.  Else what two of them make, which may be many times
        more than either has, is counted from their values, and the order with the least in between is taken.
        """
        usual = [None, *ordered(list(self.rule.body))]
        frames: dict[int | None, tuple[DataFrame, list[Var]]] = {None: (facts, self.rule.head.variables())}
        for i, atom in enumerate(self.rule.body):
            if atom.variables():
                frames[i] = selected(self.kb, atom).select(*(F.col(f"c{atom.args.index(v)}").alias(name_of(v)) for v in atom.variables())), atom.variables()
        if not 3 <= len(frames) <= MOST_ORDERED:
            return usual
        atoms = {i: self.rule.head if i is None else self.rule.body[i] for i in frames}
        # what is kept by groups is counted by groups
        groups = {i: self.kb.grouped[a.relation] for i, a in atoms.items() if a.relation in self.kb.grouped and len(set(a.variables())) == 2 and (i is not None or a.relation not in self.kb.entailed)}

        def held(i: int | None, on: list[Var], name: str) -> DataFrame:
            if i in groups and len(on) == 1:
                return groups[i].value_counts().filter(F.col("pos") == atoms[i].args.index(on[0])).select(F.col("val").alias(name_of(on[0])), F.col("n").cast("double").alias(name))
            return frames[i][0].groupBy(*map(name_of, on)).agg(F.count("*").cast("double").alias(name))

        counts = [(groups[i].count() if i in groups else df.agg(F.count("*").alias("n"))).select(F.lit(f"{i}").alias("what"), F.col("n").cast("double").alias("n")) for i, (df, _) in frames.items()]
        whole: list[tuple[int | None, int | None]] = []
        for (i, (_, x)), (k, (_, y)) in itertools.combinations(frames.items(), 2):
            if not (on := [v for v in x if v in y]):
                continue
            if any(None not in atoms[j].args and len(on) == len(atoms[j].variables()) for j in (i, k)):
                whole.append((i, k))  # a row of one meets one of the other at most
                continue
            met = held(i, on, "_n").join(held(k, on, "_m"), [name_of(v) for v in on])
            counts.append(met.agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0.0)).alias("n")).select(F.lit(f"{i},{k}").alias("what"), "n"))
        found = {r["what"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()}  # one row for each atom and pair
        for i, k in whole:
            found[f"{i},{k}"] = max(found[f"{j}"] for j in (i, k))

        def most(order: tuple[int | None, ...]) -> tuple[float, bool]:
            """Rows in between as far as pairs tell; the head first where orders are alike."""
            rows, out = found[f"{order[0]}"], 0.0
            for n, i in enumerate(order[1:], 1):
                rows *= found[f"{i}"]
                for k in order[:n]:
                    key = f"{k},{i}" if f"{k},{i}" in found else f"{i},{k}"
                    if key in found:
                        rows *= found[key] / max(found[f"{i}"] * found[f"{k}"], 1.0)
                out += rows
            return out, order[0] is not None

        best = min([tuple(i for i in usual if i in frames), *itertools.permutations(frames)], key=most)
        return [*best, *(i for i in usual if i not in frames)]


def power(symbols: int, free: int) -> float:
    return math.pow(symbols, free)
