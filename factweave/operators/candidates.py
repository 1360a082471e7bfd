"""Refinements of a rule, and the scores of all refinements of a whole level of the search in one job.

A refinement changes one thing in its parent, so none needs a plan of its own, and none needs
more of the parent's body than one projection.  Let a *key* be the values of the variables that
head and body share.  For each parent there are

* its head facts, counted by key, with those entailed before told apart;
* the keys of its body, with masks that tell for each column that some refinement asks for which columns of the
  knowledge base, and which constants, hold a value bound with the key; pairs of key and value are never made (:mod:`plans.masks`).
  Parts of a body that share no variable are kept apart, and their numbers multiplied;
* where a head column may equal one of a body of one atom, the different pairs of key and value, no more than it has facts;
* for each head column, its values among the facts that the body reaches, counted.

Then a further atom or a constant is a bit of a mask, or of the head's values a join with the long table of
column domains; an equality is a filter or a join of head and body by key and value.  What is
counted are different keys, to which the head's counts are added by one join.  The tables of all
parents of a level are stacked, so their number does not change the number of jobs.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import RulePlan, connected, selected
from ..plans.fingerprint import Tabu, fingerprint
from ..plans.masks import Keys, Wish, column_masks, key_of, keys, with_masks
from ..plans.pairs import touches
from ..plans.rule import Rule, Step, Var
from ..sources.shared import done_with, written
from .kb import KnowledgeBase, union

Place = tuple[int, int]


@dataclass(frozen=True)
class Candidate:
    step: Step
    rule: Rule


@dataclass
class Seen:
    """What a search has met; one for each rule that is looked for, the tabu table for each relation."""

    prints: set = field(default_factory=set)
    tabu: Tabu = field(default_factory=Tabu)
    observed: list[tuple[str, Rule, Rule | None]] | None = None  # with a list given, what was cut and why
    first: dict = field(default_factory=dict, repr=False)
    duplicate: int = 0
    invalid: int = 0
    covered_less: int = 0
    evaluated: int = 0


def specialisations(rule: Rule, arities: dict[str, int], constants: dict[tuple[str, int], list[str]], similar=lambda a, b: True) -> Iterator[Candidate]:
    """All refinements of a rule, in a fixed order.

    ``similar`` may rule out columns that have too little in common to be joined.
    """
    column = lambda place: (rule.atoms[place[0]].relation, place[1])
    fits = lambda one, others: all(similar(one, o) for o in others)
    empty = rule.empty_places
    news = [(name, arity, i) for name, arity in sorted(arities.items()) for i in range(arity)]
    for n in range(rule.n_vars):
        v = Var(n)
        uses = [column(p) for p in rule.places(lambda a: a == v)]  # noqa: B023
        for place in empty:
            if fits(column(place), uses):
                yield Candidate(s := Step(1, (place, v)), s.apply(rule))
        for name, arity, i in news:
            if fits((name, i), uses):
                yield Candidate(s := Step(2, (name, arity, i, v)), s.apply(rule))
    for k, place in enumerate(empty):
        for value in constants.get(column(place), ()):
            yield Candidate(s := Step(5, (place, value)), s.apply(rule))
        for other in empty[k + 1 :]:
            if similar(column(place), column(other)):
                yield Candidate(s := Step(3, (place, other)), s.apply(rule))
        for name, arity, i in news:
            if similar(column(place), (name, i)):
                yield Candidate(s := Step(4, (name, arity, i, place)), s.apply(rule))


def symmetric_specialisations(rule: Rule, arities: dict[str, int], *_, **__) -> Iterator[Candidate]:
    """Only rules ``p(X,Y):-q(X,Y)`` and ``p(X,Y):-q(Y,X)`` of binary relations."""
    if rule.head.arity != 2 or rule.length >= 2:
        return
    if not rule.body:
        for name, arity in sorted(arities.items()):
            for i in (0, 1) if arity == 2 else ():
                yield Candidate(s := Step(4, (name, 2, i, (0, 0))), s.apply(rule))
    else:
        at = rule.body[0].args.index(None)
        yield Candidate(s := Step(3, ((0, 1), (1, at))), s.apply(rule))


def generalisations(rule: Rule) -> Iterator[Rule]:
    for place in rule.places(lambda a: a is not None):
        yield rule.generalise(place)


def admitted(candidates: Iterator[Candidate], seen: Seen) -> list[Candidate]:
    """Those that are new, valid and not known to cover too little."""
    out = []
    for c in candidates:
        own = fingerprint(c.rule)
        if own in seen.prints:
            seen.duplicate += 1
            if seen.observed is not None:
                seen.observed.append(("duplicate", c.rule, seen.first.get(own)))
            continue
        seen.prints.add(own)
        if seen.observed is not None:
            seen.first[own] = c.rule
        if c.rule.invalid():
            seen.invalid += 1
        elif not seen.tabu.hit(c.rule):
            out.append(c)
        elif seen.observed is not None:
            seen.observed.append(("tabu", c.rule, None))
    return out


@dataclass
class Count:
    """Head facts that a refinement entails, not yet (``new``) and already (``old``) entailed, and all that it entails."""

    new: int = 0
    old: int = 0
    all: float = 0.0


class Parent:
    """Projections of one rule of which its refinements are counted."""

    def __init__(self, kb: KnowledgeBase, rule: Rule):
        self.kb, self.rule = kb, rule
        plan = RulePlan(kb, rule)
        self.free, self.shared = plan.free, plan.shared
        #: Atoms of each part of the body; a rule without a body has one empty part.
        self.parts: list[tuple[int, ...]] = connected(rule.body) or [()]

    def part_of(self, column: Place | Var) -> int | None:
        """The part of the body that a place or a variable is in."""
        at = {i for i, a in enumerate(self.rule.body) if column in a.args} if isinstance(column, Var) else {column[0] - 1} - {-1}
        return next((n for n, part in enumerate(self.parts) if at & set(part)), None)

    def head_column(self, column: Place | Var) -> str:
        """The head's column of a place or of a variable that the head has."""
        return f"c{self.rule.head.args.index(column) if isinstance(column, Var) else column[1]}"

    def bound(self, part: tuple[int, ...]) -> list[Var]:
        """The shared variables of a part."""
        own = {v for i in part for v in self.rule.body[i].variables()}
        return [v for v in self.shared if v in own]

    def head_key(self, part: tuple[int, ...]) -> Column:
        return key_of([F.col(self.head_column(v)) for v in self.bound(part)])

    def facts(self) -> DataFrame:
        """Facts that fit the head, with ``is_old``."""
        head = self.rule.head
        return selected(self.kb, head, self.kb.marked(head.relation))

    def keyed(self, facts: DataFrame, part: tuple[int, ...], found: Keys) -> DataFrame:
        """The facts with their ``key`` of a part, in the form that ``found`` has keys."""
        return found.facts(facts, {v: F.col(self.head_column(v)) for v in self.bound(part)}, self.bound(part))

    def reached(self) -> DataFrame:
        """Those of the facts that the body reaches."""
        out = self.facts()
        for part in self.parts:
            if part:
                found = self.keys(part)
                out = self.keyed(out, part, found).join(found.frame.select(found.key(self.bound(part)).alias("key")), "key", "left_semi").drop("key")
        return out

    def keys(self, part: tuple[int, ...], body: tuple | None = None, wishes: dict | None = None, masked: Callable[[str], DataFrame] | None = None) -> Keys:
        """The different keys of connected atoms of the body, or of the refined ``body``."""
        if not part:
            return Keys(self.kb.spark.range(1).select(F.lit(1.0).alias("w")))
        body, bound = body or self.rule.body, self.bound(part)
        return keys(self.kb, tuple(body[i] for i in part), bound, wishes, masked)

    def pairs(self, part: tuple[int, ...], columns: dict[Place | Var, int]) -> DataFrame:
        """``slot, key, val``: for each numbered column of the one atom of a part the different pairs of key and value, by one scan and one shuffle."""
        atom = self.rule.body[part[0]]
        at = lambda c: f"c{atom.args.index(c) if isinstance(c, Var) else c[1]}"
        each = F.explode(F.array(*(F.struct(F.lit(slot).alias("slot"), F.col(at(c)).alias("val")) for c, slot in columns.items())))
        rows = selected(self.kb, atom).select(key_of([F.col(at(v)) for v in self.bound(part)]).alias("key"), each.alias("x"))
        return rows.select("x.slot", "key", "x.val").distinct()

    def column_in(self, part: tuple[int, ...], column: Place | Var) -> Place:
        """Atom of a part and position where a column stands, a variable where it stands first."""
        if isinstance(column, Var):
            return next((k, self.rule.body[i].args.index(column)) for k, i in enumerate(part) if column in self.rule.body[i].args)
        return part.index(column[0] - 1), column[1]


def _sums() -> list[Column]:
    return [F.sum("new").alias("new"), F.sum("old").alias("old")]


def _marks() -> list[Column]:
    return [F.count_if(~F.col("is_old")).alias("new"), F.count_if("is_old").alias("old")]


#: Refinements of a head that is kept by groups which are counted by plans of their own; more of them are stacked.
FEW = 8


class Level:
    """Counts the refinements of several parents, which may be of one relation or of many."""

    def __init__(self, kb: KnowledgeBase, domains: DataFrame, sizes: dict[tuple[str, int], int], symbols: int):
        self.kb, self.domains, self.sizes, self.symbols = kb, domains, sizes, float(symbols)
        self.places = {c: n for n, c in enumerate(sorted(sizes))}
        self._masks: DataFrame | None = None
        self._masked: dict[str, DataFrame] = {}
        self._lock = threading.Lock()  # searches run side by side

    def masked(self, relation: str) -> DataFrame:
        """A relation with the masks of its values; written once, when it is first asked for."""
        with self._lock:
            if self._masks is None:
                self._masks = written(column_masks(self.domains, list(self.places)), "masks")
            if relation not in self._masked:
                self._masked[relation] = written(with_masks(self.kb[relation], self._masks), "masked")
            return self._masked[relation]

    def close(self) -> None:
        for df in [*self._masked.values(), *([] if self._masks is None else [self._masks])]:
            done_with(df)
        self._masks, self._masked = None, {}

    def _alone(self, candidates: list[Candidate]) -> list[Count]:
        """Counts of refinements by their own plans, which need no pairs of a head that is kept by groups."""
        plans = [RulePlan(self.kb, c.rule) for c in candidates]
        found = {r["number"]: r for r in union(p.counts().withColumn("number", F.lit(i)) for i, p in enumerate(plans)).collect()} if plans else {}
        return [Count(r["new"], r["old"], r["bodies"] * self.symbols**p.free) for i, p in enumerate(plans) for r in (found[i],)]

    def count(self, work: list[tuple[Rule, list[Candidate]]]) -> list[list[Count]]:
        """For each parent the counts of its refinements."""
        alone = [touches(RulePlan(self.kb, rule)) and len(candidates) <= FEW for rule, candidates in work]
        if any(alone):
            counts = iter(self.count([w for w, own in zip(work, alone, strict=True) if not own]) if not all(alone) else [])
            return [self._alone(candidates) if own else next(counts) for (_, candidates), own in zip(work, alone, strict=True)]
        ask = _Asked(self)
        for rule, candidates in work:
            ask.parent(Parent(self.kb, rule), candidates)
        found = {r["number"]: r for r in ask.frame().collect()} if ask.refinements else {}
        size = lambda number: found[number]["n"] if number in found else 0
        out: list[list[Count]] = [[] for _ in work]
        for number, (n, candidate, how, touched) in enumerate(ask.refinements):
            p, r = ask.parents[n], found.get(number)
            c = Count(int(r["new"] or 0), int(r["old"] or 0)) if r else Count()
            others = 1.0
            for k in range(len(p.parts)):
                others *= 1 if k in touched else size(ask.sizes[n, k])
            if how == "body":
                c.all = (r["n"] if r else 0) * others * self.symbols**p.free
            elif how == "joined":
                c.all = (r["n"] if r else 0) * others * self.symbols ** (p.free - 1)
            elif how == "both":
                c.all = size(ask.slot_size[ask.mixed[number][0]]) * others * self.symbols ** (p.free - 1)
            else:
                values = self.sizes.get((candidate.step.args[0], candidate.step.args[2]), 0) if candidate.step.case in (2, 4) else 1
                c.all = others * values * self.symbols ** (p.free - 1)
            out[n].append(c)
        return out


class _Asked:
    """What a level asks for, gathered into few tables.

    Numbers from 0 are refinements; those beyond are sizes of parts and of slots.
    """

    def __init__(self, level: Level):
        self.kb, self.level = level.kb, level
        self.parents: list[Parent] = []
        #: Parent, refinement, where it works, and the parts that it touches.
        self.refinements: list[tuple[int, Candidate, str, tuple[int, ...]]] = []
        self.n_slots = 0
        self.wishes: dict[tuple[int, int], dict[Place, Wish]] = {}  # what is asked of body columns by parent and part
        self.slots: dict[tuple[int, int], dict[Place | Var, int]] = {}  # columns of bodies of one atom that a head column may equal
        self.values: list[dict[Place | Var, int]] = []  # head columns by parent
        self.domain: list[tuple[int, int, str, int]] = []
        self.constant: list[tuple[int, int, str]] = []
        self.mixed: dict[int, tuple[int, int]] = {}
        self.meeting: dict[tuple[int, int], set[int]] = {}  # slots of head columns that meet a column of a part
        self.in_body: list[tuple[int, int, tuple[int, ...], tuple]] = []
        self.joined: list[tuple[int, int, Parent, tuple[int, ...]]] = []  # head and a joined body share a further variable
        self.in_head: list[list[tuple[int, str, str]]] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.slot_size: dict[int, int] = {}

    def _slot(self, column: Place | Var, table: dict) -> int:
        if column not in table:
            table[column] = self.n_slots
            self.n_slots += 1
        return table[column]

    def parent(self, p: Parent, candidates: list[Candidate]) -> None:
        n = len(self.parents)
        self.parents.append(p)
        self.values.append({})
        self.in_head.append([])
        for c in candidates:
            number, step = len(self.refinements), c.step
            touched: tuple[int, ...] = ()
            if step.case in (1, 3):
                parts = [p.part_of(x) for x in step.args]
                if parts[0] is None and (parts[1] is None or step.args[1] in p.shared):
                    how = "head"
                    self.in_head[n].append((number, *(p.head_column(x) for x in step.args)))
                elif None in parts:
                    how = "both"
                    (head, _), (body, part) = sorted(zip(step.args, parts, strict=True), key=lambda x: x[1] is not None)
                    touched = (part,)
                    if len(p.parts[part]) > 1:
                        self.joined.append((n, number, Parent(self.kb, c.rule), p.parts[part]))
                        self.refinements.append((n, c, "joined", touched))
                        continue
                    self.mixed[number] = (self._slot(body, self.slots.setdefault((n, part), {})), self._slot(head, self.values[n]))
                    self.meeting.setdefault((n, part), set()).add(self.mixed[number][1])
                else:
                    how, touched = "body", tuple(sorted(set(parts)))
                    self.in_body.append((n, number, touched, c.rule.body))
            else:
                column = step.args[3] if step.case in (2, 4) else step.args[0]
                part = p.part_of(column)
                how, touched = ("head", ()) if part is None else ("body", (part,))
                if part is not None:
                    wish = self.wishes.setdefault((n, part), {}).setdefault(p.column_in(p.parts[part], column), Wish())
                    if step.case == 5:
                        wish.constants[step.args[1]] = number
                    elif (step.args[0], step.args[2]) in self.level.places:
                        wish.places[self.level.places[step.args[0], step.args[2]]] = number
                    self.refinements.append((n, c, how, touched))
                    continue
                slot = self._slot(column, self.values[n])
                if step.case == 5:
                    self.constant.append((number, slot, step.args[1]))
                else:
                    self.domain.append((number, slot, step.args[0], step.args[2]))
            self.refinements.append((n, c, how, touched))

    def frame(self) -> DataFrame:
        """``number, new, old, n``: one row for each refinement and for each size that is needed beside."""
        domains = self.level.domains
        spark, used = self.kb.spark, sorted({n for n, *_ in self.refinements})
        number_of: dict[tuple[int, tuple[int, ...]], int] = {}  # parent and parts that are counted together
        group = lambda n, parts: F.lit(number_of.setdefault((n, parts), len(number_of))).alias("grp")
        for n in used:
            for k in range(len(self.parents[n].parts)):
                self.sizes[n, k] = len(self.refinements) + len(self.sizes)
        # what is asked for is bounded by the catalogue
        asked = F.broadcast(spark.createDataFrame(self.domain, "number int, slot int, rel string, pos int")) if self.domain else None
        constants = F.broadcast(spark.createDataFrame(self.constant, "number int, slot int, val string")) if self.constant else None

        def joined(table: DataFrame) -> list[DataFrame]:
            """The rows of a table of slots and values that refinements ask for."""
            out = [table.join(domains, "val").join(asked, ["slot", "rel", "pos"]).drop("rel", "pos", "val", "slot")] if asked is not None else []
            return out + ([table.join(constants, ["slot", "val"]).drop("val", "slot")] if constants is not None else [])

        pairs, hits, counted, equal, levels, heads = [], [], [], [], [], []
        for (n, k), slots in self.slots.items():
            p = self.parents[n]
            pairs.append(p.pairs(p.parts[k], slots).withColumn("grp", group(n, (k,))))
        table = union(pairs) if pairs else None
        own_heads: list[tuple[Parent, tuple[int, ...], Keys, Column]] = []  # groups whose keys have a form of their own

        def met(n: int, p: Parent, atoms: tuple[int, ...], found: Keys, numbers: list[Column], shared: tuple[int, ...] | None) -> None:
            """Keys, each with the refinements of ``numbers`` that bind it, to be met by the facts of a parent, as far as they have the form that all of its groups share."""
            if found.classes or shared is None:
                grp = F.lit(number_of.setdefault((n, ("own", len(own_heads))), len(number_of))).alias("grp")
                own_heads.append((p, atoms, found, grp))
            else:
                grp = group(n, shared)
            hits.append(found.frame.select(F.array_compact(F.array(*numbers)).alias("numbers"), grp, found.key(p.bound(atoms)).alias("key"), "w"))

        for (n, k), number in self.sizes.items():
            p = self.parents[n]
            found = p.keys(p.parts[k], None, self.wishes.get((n, k)), self.level.masked)
            met(n, p, p.parts[k], found, [F.lit(number), *(F.when(is_in, F.lit(i)) for i, is_in in found.numbers.items())], (k,))
        for n, number, parts, body in self.in_body:
            p = self.parents[n]
            atoms = tuple(sorted(i for k in parts for i in p.parts[k]))
            met(n, p, atoms, p.keys(atoms, body), [F.lit(number)], parts)
        for n, number, p, atoms in self.joined:
            met(n, p, atoms, p.keys(atoms), [F.lit(number)], None)
        for p, atoms, found, grp in own_heads:
            heads.append(p.keyed(p.reached() if len(p.parts) > 1 else p.facts(), atoms, found).groupBy("key").agg(*_marks()).withColumn("grp", grp))
        for n in used:
            p, single = self.parents[n], self.values[n]
            seen = p.reached()
            facts = seen if len(p.parts) > 1 else p.facts()  # with a single part the join below tells what is reached
            shared = [(grp, tuple(sorted(i for k in parts for i in p.parts[k]))) for (m, parts), grp in number_of.items() if m == n and parts[:1] != ("own",)]
            if shared:  # one pass over the facts for all groups
                groups = F.explode(F.array(*(F.struct(F.lit(grp).alias("grp"), p.head_key(atoms).alias("key")) for grp, atoms in shared)))
                heads.append(facts.select("is_old", groups.alias("g")).groupBy("g.grp", "g.key").agg(*_marks()))
            if single:
                each = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.col(p.head_column(c)).alias("val")) for c, s in single.items())))
                if {x[1] for x in (*self.domain, *self.constant)} & set(single.values()):
                    counted.append(seen.select("is_old", each.alias("x")).groupBy("x.slot", "x.val").agg(*_marks()))
                for k, part in enumerate(p.parts):
                    if (n, k) in self.meeting:
                        rows = facts.select(p.head_key(part).alias("key"), "is_old", each.alias("x")).filter(F.col("x.slot").isin(*self.meeting[n, k]))
                        levels.append(rows.groupBy(F.col("x.slot").alias("head_slot"), "key", F.col("x.val").alias("val")).agg(*_marks()).withColumn("grp", group(n, (k,))))
            if self.in_head[n]:
                cases = F.array(*(F.when(F.col(a) == F.col(b), F.lit(number)) for number, a, b in self.in_head[n]))
                equal.append(seen.select("is_old", F.explode(F.array_compact(cases)).alias("number")).groupBy("number").agg(*_marks()))
        none = F.lit(None).cast("double")
        # a key meets its facts once, whatever the number of refinements that bind it
        held = union(hits).join(union(heads), ["grp", "key"], "left").select(F.explode("numbers").alias("number"), "new", "old", "w")
        out = [held.groupBy("number").agg(*_sums(), F.sum("w").alias("n"))]
        if counted:
            equal += joined(union(counted))
        if equal:
            out.append(union(x.select("number", "new", "old") for x in equal).groupBy("number").agg(*_sums()).select("number", "new", "old", none.alias("n")))
        if levels:
            wanted = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in self.mixed.items()], "number int, slot int, head_slot int"))
            met = table.join(union(levels), ["grp", "key", "val"]).join(wanted, ["slot", "head_slot"])
            out.append(met.groupBy("number").agg(*_sums()).select("number", "new", "old", none.alias("n")))
            first = len(self.refinements) + len(self.sizes)
            self.slot_size = {slot: first + slot for slot, _ in self.mixed.values()}
            sized = table.filter(F.col("slot").isin(*self.slot_size)).groupBy("slot").agg(F.count("*").cast("double").alias("n"))
            out.append(sized.select((F.col("slot") + first).alias("number"), F.lit(None).cast("long").alias("new"), F.lit(None).cast("long").alias("old"), "n"))
        return union(out)


def domain_sizes(domains: DataFrame) -> dict[tuple[str, int], int]:
    """Different values of each column; one row for each column of the catalogue."""
    return {(r["rel"], r["pos"]): r["n"] for r in domains.groupBy("rel", "pos").agg(F.count("*").alias("n")).collect()}


__all__ = ["Candidate", "Count", "Level", "Parent", "Seen", "admitted", "domain_sizes", "generalisations", "specialisations", "symmetric_specialisations"]
