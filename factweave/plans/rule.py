"""Horn rules over relations of symbols: structure, text form, validity and refinement.

An argument is ``None`` (any value, used once), a :class:`Var` (used twice or more) or a
:class:`Const`.  A rule is a head atom and a tuple of body atoms; it is small, immutable and
lives on the driver only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace


class RuleParseError(ValueError):
    """The text is no rule."""


@dataclass(frozen=True, order=True)
class Var:
    id: int


@dataclass(frozen=True, order=True)
class Const:
    value: str


Arg = Var | Const | None


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Arg, ...]

    @property
    def arity(self) -> int:
        return len(self.args)

    def variables(self) -> list[Var]:
        return list(dict.fromkeys(a for a in self.args if isinstance(a, Var)))

    def __str__(self) -> str:
        return f"{_symbol(self.relation)}({','.join(map(_argument, self.args))})"


_PLAIN = re.compile(r"[a-z][A-Za-z0-9_]*\Z")


def _symbol(name: str) -> str:
    return name if _PLAIN.match(name) else "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _argument(arg: Arg) -> str:
    if arg is None:
        return "?"
    return f"X{arg.id}" if isinstance(arg, Var) else _symbol(arg.value)


@dataclass(frozen=True)
class Rule:
    atoms: tuple[Atom, ...]

    @property
    def head(self) -> Atom:
        return self.atoms[0]

    @property
    def body(self) -> tuple[Atom, ...]:
        return self.atoms[1:]

    @property
    def n_vars(self) -> int:
        return len({a for atom in self.atoms for a in atom.args if isinstance(a, Var)})

    @property
    def length(self) -> int:
        """Arguments that are not empty, less the different variables."""
        return sum(a is not None for atom in self.atoms for a in atom.args) - self.n_vars

    def places(self, wanted=lambda a: True) -> list[tuple[int, int]]:
        """Places (atom, argument) whose argument is ``wanted``."""
        return [(p, i) for p, atom in enumerate(self.atoms) for i, a in enumerate(atom.args) if wanted(a)]

    @property
    def empty_places(self) -> list[tuple[int, int]]:
        return self.places(lambda a: a is None)

    def __str__(self) -> str:
        return f"{self.head}:-{','.join(map(str, self.body))}"

    def with_arg(self, place: tuple[int, int], arg: Arg) -> Rule:
        p, i = place
        atom = self.atoms[p]
        changed = replace(atom, args=(*atom.args[:i], arg, *atom.args[i + 1 :]))
        return Rule((*self.atoms[:p], changed, *self.atoms[p + 1 :]))

    def with_atom(self, relation: str, arity: int, at: int, arg: Arg) -> Rule:
        return Rule((*self.atoms, Atom(relation, tuple(arg if i == at else None for i in range(arity)))))

    # -- refinements -------------------------------------------------------------------

    def bind(self, place: tuple[int, int], var: Var) -> Rule:
        """An empty argument takes a variable that the rule has."""
        self._empty(place)
        return self.with_arg(place, var)

    def bind_new_atom(self, relation: str, arity: int, at: int, var: Var) -> Rule:
        """A further atom takes a variable that the rule has."""
        return self.with_atom(relation, arity, at, var)

    def unify(self, one: tuple[int, int], other: tuple[int, int]) -> Rule:
        """Two empty arguments take a new variable."""
        self._empty(one)
        self._empty(other)
        new = Var(self.n_vars)
        return self.with_arg(one, new).with_arg(other, new)

    def unify_new_atom(self, relation: str, arity: int, at: int, place: tuple[int, int]) -> Rule:
        """An empty argument and one of a further atom take a new variable."""
        self._empty(place)
        new = Var(self.n_vars)
        return self.with_arg(place, new).with_atom(relation, arity, at, new)

    def assign(self, place: tuple[int, int], value: str) -> Rule:
        """An empty argument takes a constant."""
        self._empty(place)
        return self.with_arg(place, Const(value))

    def _empty(self, place: tuple[int, int]) -> None:
        if self.atoms[place[0]].args[place[1]] is not None:
            raise ValueError(f"argument {place} of {self} is in use")

    def generalise(self, place: tuple[int, int]) -> Rule:
        """Empties an argument; a variable left with one use goes too, and so do body atoms without arguments in use."""
        arg = self.atoms[place[0]].args[place[1]]
        if arg is None:
            raise ValueError(f"argument {place} of {self} is empty already")
        out = self.with_arg(place, None)
        if isinstance(arg, Var):
            left = out.places(lambda a: a == arg)
            if len(left) == 1:
                out = out.with_arg(left[0], None)
        kept = [out.head, *(a for a in out.body if any(x is not None for x in a.args))]
        return renumbered(Rule(tuple(kept)), keep_order=True)

    # -- validity ----------------------------------------------------------------------

    def invalid(self) -> str | None:
        """Why the search may not use the rule, or nothing."""
        head_vars = self.head.variables()
        if self.body and not head_vars:
            return "the head shares no variable with the body"
        complete: set[Atom] = set()
        for atom in self.body:
            if atom.relation == self.head.relation and any(a is not None and a == b for a, b in zip(self.head.args, atom.args, strict=False)):
                return "a body atom repeats an argument of the head"
            if None not in atom.args:
                if atom in complete:
                    return "a body atom is repeated"
                complete.add(atom)
            if not atom.variables():
                return "a body atom has no variable"
        return "the rule falls into parts" if len(self.components()) > 1 else None

    def components(self) -> list[set[Var]]:
        """Variables joined by standing in one atom."""
        groups: list[set[Var]] = []
        for atom in self.atoms:
            new = set(atom.variables())
            if new:
                apart = [g for g in groups if not g & new]
                groups = [*apart, set().union(new, *(g for g in groups if g & new))]
        return groups


def renumbered(rule: Rule, keep_order: bool = False) -> Rule:
    """Variables numbered from 0: in the order of their numbers, or as they first stand."""
    used = list(dict.fromkeys(a for atom in rule.atoms for a in atom.args if isinstance(a, Var)))
    if keep_order:
        used.sort()
    to = {v: Var(i) for i, v in enumerate(used)}
    return Rule(tuple(replace(a, args=tuple(to.get(x, x) if isinstance(x, Var) else x for x in a.args)) for a in rule.atoms))


def start_rule(relation: str, arity: int) -> Rule:
    return Rule((Atom(relation, (None,) * arity),))


# -- text ------------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<quoted>'(?:[^'\\]|\\.)*')|(?P<name>[^\s'(),?:\-]+)|(?P<mark>:-|[(),?]))""")


def _tokens(text: str):
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleParseError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m["quoted"]:
            yield "symbol", re.sub(r"\\(.)", r"\1", m["quoted"][1:-1])
        elif m["name"]:
            yield ("variable" if m["name"][0].isupper() else "symbol"), m["name"]
        else:
            yield "mark", m["mark"]


def parse_rule(text: str) -> Rule:
    """``h(X,?):-p(X,Y),q(Y,c)``; capitals begin variables, other constants may stand in quotes.

    A variable that is used once is an empty argument; variables are numbered as they come.
    """
    tokens = [*_tokens(text), ("end", "")]
    at = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal at
        k, v = tokens[at]
        if k != kind or value is not None and v != value:
            raise RuleParseError(f"expected {value or kind}, found {v or 'the end'!r} in {text!r}")
        at += 1
        return v

    def atom() -> tuple[str, list]:
        nonlocal at
        name = take("symbol")
        take("mark", "(")
        args: list = []
        while True:
            kind, value = tokens[at]
            if (kind, value) == ("mark", "?"):
                args.append(None)
            elif kind in ("variable", "symbol"):
                args.append((kind, value))
            else:
                raise RuleParseError(f"expected an argument, found {value!r} in {text!r}")
            at += 1
            if tokens[at] == ("mark", ")"):
                at += 1
                return name, args
            take("mark", ",")

    atoms = [atom()]
    take("mark", ":-")
    while tokens[at][0] != "end":
        if len(atoms) > 1:
            take("mark", ",")
        atoms.append(atom())
    uses = Counter(a for _, args in atoms for a in args if a and a[0] == "variable")
    numbers: dict[str, Var] = {}

    def convert(a) -> Arg:
        if a is None or a[0] == "variable" and uses[a] < 2:
            return None
        return numbers.setdefault(a[1], Var(len(numbers))) if a[0] == "variable" else Const(a[1])

    return Rule(tuple(Atom(name, tuple(map(convert, args))) for name, args in atoms))


# -- construction ----------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One refinement, by the number of its kind and its arguments."""

    case: int
    args: tuple

    def apply(self, rule: Rule) -> Rule:
        return (rule.bind, rule.bind_new_atom, rule.unify, rule.unify_new_atom, rule.assign)[self.case - 1](*self.args)


def construction(rule: Rule) -> list[Step]:
    """Refinements that lead from the bare head to ``rule``, up to the names of variables and the order of atoms.

    Atoms enter as soon as they share a variable with what stands already; a rule that
    falls into parts has no construction.
    """
    order, steps = [0], []
    place_of: dict[Var, list[tuple[int, int]]] = {}
    number: dict[Var, int] = {}
    now = start_rule(rule.head.relation, rule.head.arity)

    def put(step: Step) -> None:
        nonlocal now
        steps.append(step)
        now = step.apply(now)

    def settle(p: int, skip: int | None = None) -> None:
        """Bind what can be bound in atom ``p`` of the rule, now the last that entered."""
        at = order.index(p)
        for i, a in enumerate(rule.atoms[p].args):
            if isinstance(a, Var) and i != skip:
                if a in number:
                    put(Step(1, ((at, i), Var(number[a]))))
                elif a in place_of:
                    number[a] = now.n_vars
                    put(Step(3, (place_of[a][0], (at, i))))
                else:
                    place_of[a] = [(at, i)]
            elif isinstance(a, Const):
                put(Step(5, ((at, i), a.value)))

    settle(0)
    waiting = list(range(1, len(rule.atoms)))
    while waiting:
        found = next(((p, i, a) for p in waiting for i, a in enumerate(rule.atoms[p].args) if isinstance(a, Var) and (a in number or a in place_of)), None)
        if found is None:
            raise RuleParseError(f"{rule} falls into parts")
        p, i, a = found
        atom = rule.atoms[p]
        order.append(p)
        waiting.remove(p)
        if a in number:
            put(Step(2, (atom.relation, atom.arity, i, Var(number[a]))))
        else:
            number[a] = now.n_vars
            put(Step(4, (atom.relation, atom.arity, i, place_of[a][0])))
        settle(p, skip=i)
    return steps
