"""Fingerprints of rules: what tells two rules apart quickly, and the tabu table built on them.

A variable's class holds the columns it stands in; an empty argument is a class of its own,
a constant one of its column and its value.  Classes that reach into the head carry the
head's positions.  Rules of equal fingerprints count as one, although a few different rules
share theirs (the classes do not say which columns stand in the same atom).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

from .rule import Const, Rule, Var


@dataclass(frozen=True)
class Fingerprint:
    head: str
    classes: frozenset  # of (class, head positions) with their number

    @cached_property
    def bare(self) -> list[Counter]:
        return [Counter(dict(c)) for (c, _), _ in self.classes]

    def generalises(self, other: Fingerprint) -> bool:
        """Each of its classes is part of some class of ``other``; heads are not looked at."""
        return all(any(not mine - its for its in other.bare) for mine in self.bare)


def fingerprint(rule: Rule) -> Fingerprint:
    by_var: dict[Var, Counter] = {}
    labels: dict[Var, list[int]] = {}
    classes: list[tuple[Counter, tuple[int, ...]]] = []
    for p, atom in enumerate(rule.atoms):
        for i, a in enumerate(atom.args):
            column, label = ("column", atom.relation, i), (i,) if p == 0 else ()
            if isinstance(a, Var):
                by_var.setdefault(a, Counter())[column] += 1
                labels.setdefault(a, []).extend(label)
            elif isinstance(a, Const):
                classes.append((Counter([column, ("constant", a.value)]), label))
            else:
                classes.append((Counter([column]), label))
    classes += [(c, tuple(labels[v])) for v, c in by_var.items()]
    counted = Counter((frozenset(c.items()), label) for c, label in classes)
    return Fingerprint(rule.head.relation, frozenset(counted.items()))


class Tabu:
    """Fingerprints of rules with too little coverage, by the relations of their bodies.

    Whatever such a rule generalises covers even less.
    """

    def __init__(self) -> None:
        self.table: dict[tuple[str, ...], set[Fingerprint]] = {}
        self.hits = 0

    def add(self, rule: Rule) -> None:
        self.table.setdefault(self.relations(rule), set()).add(fingerprint(rule))

    @staticmethod
    def relations(rule: Rule) -> tuple[str, ...]:
        return tuple(sorted(a.relation for a in rule.body))

    @staticmethod
    def subsets(rule: Rule) -> set[tuple[str, ...]]:
        names = Tabu.relations(rule)
        return {s for n in range(len(names) + 1) for s in combinations(names, n)}

    def hit(self, rule: Rule) -> bool:
        own = fingerprint(rule)
        found = any(f.generalises(own) for s in self.subsets(rule) for f in self.table.get(s, ()))
        self.hits += found
        return found

    def __len__(self) -> int:
        return sum(map(len, self.table.values()))
