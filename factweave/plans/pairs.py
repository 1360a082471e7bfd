"""Rules over relations that are kept by groups: counted without their pairs.

A body that binds two variables is itself a relation between groups where it is such a relation, or a chain of two
atoms over one further variable: of two such relations, or of plain ones whose values fall into classes (:mod:`plans.masks`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import Grouped, between
from ..operators.kb import KnowledgeBase
from .compile import RulePlan, body_bindings, connected, name_of, selected
from .masks import keys
from .rule import Atom, Var


def _directed(kb: KnowledgeBase, atom: Atom, first: Var, second: Var) -> Grouped | None:
    """An atom's relation from ``first`` to ``second``, if it is kept by groups."""
    if atom.relation not in kb.grouped or set(atom.args) != {first, second}:
        return None
    found = kb.grouped[atom.relation]
    return found if atom.args[0] == first else found.swapped()


def bound_by_groups(kb: KnowledgeBase, atoms: tuple[Atom, ...], x: Var, y: Var) -> Grouped | None:
    """The bindings of two different variables in connected atoms, where they can be had by groups."""
    if len(atoms) == 1:
        return _directed(kb, atoms[0], x, y)
    if len(atoms) != 2 or any(len(a.args) != 2 or len(set(a.variables())) != 2 for a in atoms):
        return None
    a, b = atoms if x in atoms[0].args else atoms[::-1]
    between_them = set(a.args) & set(b.args)
    if len(between_them) != 1 or x not in a.args or y not in b.args or between_them & {x, y}:
        return None
    z = between_them.pop()
    one, other = _directed(kb, a, x, z), _directed(kb, b, z, y)
    if one is not None and other is not None:
        return one.then(other)
    if one is not None or other is not None:
        return None
    found = keys(kb, atoms, [x, y])
    of = {own[0]: table.select(F.col(name_of(own[0])).alias("val"), F.col("class").alias("cls")) for own, table in found.classes}
    if set(of) != {x, y}:
        return None
    return between(of[x], of[y], found.frame.select(F.col(name_of(x)).alias("s"), F.col(name_of(y)).alias("t")))


def hopped(kb: KnowledgeBase, atoms: tuple[Atom, ...], wanted: list[Var]) -> DataFrame | None:
    """The bindings of two variables in a chain of an atom that is kept by groups and a plain one."""
    if len(atoms) != 2 or len(wanted) != 2 or any(len(a.args) != 2 or len(set(a.variables())) != 2 for a in atoms):
        return None
    for a, b in (atoms, atoms[::-1]):
        mid, end = set(a.args) & set(b.args), set(a.args) & set(wanted)
        if a.relation in kb.grouped and b.relation not in kb.grouped and len(mid) == 1 and len(end) == 1 and not mid & set(wanted):
            z, x, y = mid.pop(), end.pop(), next(v for v in wanted if v not in a.args)
            rest = selected(kb, b).select(*(F.col(f"c{b.args.index(v)}").alias(name_of(v)) for v in (z, y)))
            return _directed(kb, a, x, z).hop(rest, name_of(z), name_of(x)).select(*(name_of(v) for v in wanted))
    return None


@dataclass
class Bound:
    """What one part of a body binds: by groups or as a plain table."""

    variables: list[Var]
    groups: Grouped | None
    frame: DataFrame | None

    def count(self) -> DataFrame:
        return self.groups.count() if self.groups is not None else self.frame.agg(F.count("*").alias("n"))

    def values(self, v: Var) -> DataFrame:
        """``val``: the different values of one variable."""
        if self.groups is not None:
            return self.groups.values().filter(F.col("pos") == self.variables.index(v)).select("val")
        return self.frame.select(F.col(name_of(v)).alias("val")).distinct()


def bound(plan: RulePlan) -> list[Bound]:
    out = []
    for at in connected(plan.rule.body):
        atoms = tuple(plan.rule.body[i] for i in at)
        own = {v for a in atoms for v in a.variables()}
        shared = [v for v in plan.shared if v in own]
        groups = bound_by_groups(plan.kb, atoms, *shared) if len(shared) == 2 else None
        out.append(Bound(shared, groups, None if groups is not None else body_bindings(plan.kb, atoms, shared)))
    return out


def touches(plan: RulePlan) -> bool:
    """Whether the rule's head is kept by groups, and its count of facts can be had so."""
    head = plan.rule.head
    return head.relation in plan.kb.grouped and all(a is None or isinstance(a, Var) for a in head.args)


def entailed_facts(plan: RulePlan, parts: list[Bound]) -> Grouped | DataFrame:
    """Facts of the head that the rule entails: by groups, or a table of them (``c0, c1``) that is no larger than a plain part of the body or the head's symbols."""
    head, facts = plan.rule.head, plan.kb.grouped[plan.rule.head.relation]
    x, y = head.args
    tests = [p for p in parts if not p.variables]
    of = {v: p for p in parts for v in p.variables}
    if x is not None and x == y:
        out = facts.loops()
        if x in of:
            out = out.join(of[x].values(x), "val", "left_semi")
        out = out.select(F.col("val").alias("c0"), F.col("val").alias("c1"))
    elif x in of and of[x] is of.get(y):
        p = of[x]
        if p.groups is not None:
            out = facts.met(p.groups if p.variables[0] == x else p.groups.swapped())
        else:
            out = facts.holding(p.frame.select(F.col(name_of(x)).alias("c0"), F.col(name_of(y)).alias("c1")), "c0", "c1")
    else:
        ends = [of[v].values(v) if v in of else None for v in (x, y)]
        out = facts if ends == [None, None] else facts.restricted(*ends)
    for t in tests:
        once = t.frame.limit(1).select(F.lit(True).alias("_any"))
        if isinstance(out, Grouped):
            out = Grouped(out.groups.join(F.broadcast(once), F.lit(True), "left_semi"), out.links)
        else:
            out = out.join(F.broadcast(once), F.lit(True), "left_semi")
    return out


def single_witness(plan: RulePlan) -> DataFrame | None:
    """Head facts with their witness, where head and body are one relation each that is kept by groups, with the same two variables: a fact has one witness."""
    head, body = plan.rule.head, plan.rule.body
    if not touches(plan) or head.relation in plan.kb.entailed or len(body) != 1 or len(plan.shared) != 2:
        return None
    found = bound_by_groups(plan.kb, body, *head.args)
    if found is None:
        return None
    at = {v: F.col(f"c{i}") for i, v in enumerate(head.args)}
    return plan.kb.grouped[head.relation].met(found).pairs().select("c0", "c1", F.array(*(at[v] for v in body[0].args)).alias("b0"))


def mirror(plan: RulePlan) -> Grouped | None:
    """Facts whose only witness is their exchange: of a rule ``p(X,Y):-p(Y,X)`` for a relation that is kept by groups and has no marks yet."""
    head, body = plan.rule.head, plan.rule.body
    if not touches(plan) or head.relation in plan.kb.entailed or len(body) != 1 or body[0].relation != head.relation:
        return None
    if len(set(head.variables())) != 2 or body[0].args != head.args[::-1]:
        return None
    return plan.kb.groups_of(head.relation).mirrored()


def derived_groups(plan: RulePlan) -> Grouped | None:
    """All head tuples of a rule without free places, where its head is kept by groups and its body can be had so."""
    head = plan.rule.head
    if not touches(plan) or len(plan.shared) != 2 or len(connected(plan.rule.body)) != 1:
        return None
    for name in {a.relation for a in plan.rule.body} & set(plan.kb.grouped):
        plan.kb.groups_of(name)
    found = bound_by_groups(plan.kb, plan.rule.body, *head.args)
    return None if found is None else found.written()


def number(facts: Grouped | DataFrame) -> DataFrame:
    """One row, ``n``."""
    return facts.count() if isinstance(facts, Grouped) else facts.agg(F.count("*").alias("n"))
