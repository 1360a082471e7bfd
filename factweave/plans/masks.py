"""Bodies of several atoms, counted by key without pairs of key and value.

A refinement asks of a key whether the body binds it together with a value that some column of the
knowledge base holds, or that is some constant.  Each value has a *mask*, one bit for each such
column.  The masks of an atom's column are put together by bitwise or, passed on from atom to
atom along the variables that they share, and put together again at each of them: as or distributes over
the join, a key ends with the bits of all values that it is bound with.  Nothing on the
way has more rows than an atom has facts.

Where a key takes variables of several atoms, it is the keys that multiply.  Values of an atom's own
key variables that stand beside the same values (and masks) of its other variables form a *class*; classes
are joined in place of the values, and weigh as much as there are values in them.  An order's and a customer's
nation make 25 classes on either side, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kb import KnowledgeBase
from .compile import name_of, ordered, selected
from .rule import Atom, Var

Masked = Callable[[str], DataFrame]
#: Bits of a mask that one column holds.
BITS = 62


def bit(n: int) -> int:
    return 1 << n % BITS


def column_masks(domains: DataFrame, places: list[tuple[str, int]]) -> DataFrame:
    """``val`` and ``m0, m1, ..``: which of the places (relation, position) hold each value."""
    spark = domains.sparkSession
    words = range(-(-len(places) // BITS) or 1)
    bits = F.broadcast(spark.createDataFrame([(rel, pos, n // BITS, bit(n)) for n, (rel, pos) in enumerate(places)], "rel string, pos int, word int, bit long"))  # the catalogue's columns
    return domains.join(bits, ["rel", "pos"]).groupBy("val").agg(*(F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(f"m{w}") for w in words))


def with_masks(frame: DataFrame, masks: DataFrame) -> DataFrame:
    """A relation with the masks of each of its values beside: ``m0_0, m0_1, .., m1_0, ..`` by position and word."""
    for c in frame.columns:
        at = c.removeprefix("c")
        frame = frame.join(masks.select(*(F.col(m).alias(c if m == "val" else f"m{at}_{m.removeprefix('m')}") for m in masks.columns)), c)
    return frame


@dataclass
class Wish:
    """What is asked of the values in a column of an atom: by number, the places and constants that they may be in."""

    places: dict[int, int] = field(default_factory=dict)  # bit of the catalogue -> number
    constants: dict[str, int] = field(default_factory=dict)


@dataclass
class Keys:
    """Different keys of a body; key variables of one atom may stand for classes.

    ``frame`` has the key's variables, masks and ``w``, the number of keys that a row stands for.
    """

    frame: DataFrame
    classes: list[tuple[list[Var], DataFrame]] = field(default_factory=list)
    numbers: dict[int, Column] = field(default_factory=dict)  # condition of each number that was wished for

    def key(self, bound: list[Var]) -> Column:
        return key_of([F.col(name_of(v)) for v in bound])

    def facts(self, facts: DataFrame, of: dict[Var, Column], bound: list[Var]) -> DataFrame:
        """``facts`` with ``key``; those whose values are in no class are not reached and go."""
        of = dict(of)
        for n, (own, table) in enumerate(self.classes):
            names = {v: f"_k{n}_{name_of(v)}" for v in own}
            known = table.select(*(F.col(name_of(v)).alias(names[v]) for v in own), F.col("class").alias(f"_class{n}"))
            facts = facts.join(known, reduce(Column.__and__, (of[v] == F.col(names[v]) for v in own))).drop(*names.values())
            of.update({v: F.lit("") for v in own} | {own[0]: F.col(f"_class{n}")})
        return facts.withColumn("key", key_of([of[v] for v in bound])).drop(*(f"_class{n}" for n in range(len(self.classes))))


def key_of(parts: list[Column]) -> Column:
    return F.array(*parts).cast("array<string>")


@dataclass
class _Part:
    """Rows of one atom, or of several that are joined, by variable, with masks."""

    frame: DataFrame
    variables: set[Var]
    masks: list[str]

    def cut(self, kept: set[Var]) -> _Part:
        """The different bindings of ``kept``, masks put together."""
        names = [name_of(v) for v in sorted(self.variables & kept)]
        if not self.masks and self.variables <= kept:
            return self
        if self.masks:
            some = [] if names else [F.lit(1).alias("one")]  # no row without facts
            frame = self.frame.groupBy(*names, *some).agg(*(F.bit_or(m).alias(m) for m in self.masks)).select(*names, *self.masks)
        else:
            frame = self.frame.select(*names).distinct() if names else self.frame.select(F.lit(1).alias("one")).limit(1)
        return _Part(frame, self.variables & kept, self.masks)

    def joined(self, other: _Part) -> _Part:
        on = [name_of(v) for v in sorted(self.variables & other.variables)]
        semi = not other.masks and other.variables <= self.variables
        return _Part(self.frame.join(other.frame, on, "left_semi" if semi else "inner"), self.variables | other.variables, self.masks + other.masks)


def _atom(kb: KnowledgeBase, atom: Atom, number: int, needed: set[Var], wishes: dict[int, Wish], masked: Masked | None) -> tuple[_Part, dict[int, Column]]:
    """An atom's bindings of its needed variables with the masks of the columns that wishes are for, and how to read these."""
    frame = masked(atom.relation) if any(w.places for w in wishes.values()) else None
    held, names, read = [], [], {}
    for i, wish in wishes.items():
        at = f"p{number}_{i}_"
        for w in sorted({b // BITS for b in wish.places}):
            held.append(F.col(f"m{i}_{w}").alias(f"{at}m{w}"))
            names.append(f"{at}m{w}")
        read |= {n: F.col(f"{at}m{b // BITS}").bitwiseAND(F.lit(bit(b))) != 0 for b, n in wish.places.items()}
        values = sorted(wish.constants)
        for w in range(-(-len(values) // BITS)):
            own = values[w * BITS : (w + 1) * BITS]
            found = reduce(lambda out, x: out.when(F.col(f"c{i}") == x[1], F.lit(bit(x[0]))), enumerate(own), F.when(F.lit(False), F.lit(0)))  # noqa: B023
            held.append(F.coalesce(found, F.lit(0)).cast("long").alias(f"{at}c{w}"))
            names.append(f"{at}c{w}")
            read |= {wish.constants[x]: F.col(f"{at}c{w}").bitwiseAND(F.lit(bit(k))) != 0 for k, x in enumerate(own)}
    rows = selected(kb, atom, frame).select(*(F.col(f"c{atom.args.index(v)}").alias(name_of(v)) for v in atom.variables() if v in needed), *held)
    if names:
        return _Part(rows, needed, names).cut(needed), read
    if not needed:
        return _Part(selected(kb, atom).select(F.lit(1).alias("one")).limit(1), needed, []), read
    whole = None not in atom.args and len(needed) == atom.arity  # a projection to all columns has no duplicates
    return _Part(rows if whole else rows.distinct(), needed, []), read


def _eliminated(parts: list[_Part], wanted: set[Var]) -> list[_Part]:
    """Parts whose outside variables all lie in one other part go into that one, from the leaves of the join tree on."""
    parts, i = list(parts), 0
    while i < len(parts):
        rest = parts[:i] + parts[i + 1 :]
        outside = parts[i].variables & (wanted | {v for p in rest for v in p.variables})
        into = next((k for k, p in enumerate(rest) if outside <= p.variables), None)
        if into is None:
            i += 1
            continue
        rest[into] = rest[into].joined(parts[i].cut(outside))
        parts, i = rest, 0
    return parts


def _classes(part: _Part, own: list[Var]) -> tuple[_Part, DataFrame, DataFrame]:
    """The part by classes of its own key variables; the class of each value, and how many values a class has."""
    others, names = sorted(part.variables - set(own)), [name_of(v) for v in own]
    content = [*(name_of(v) for v in others), *part.masks]
    # a class is known by its number of rows and 128 bits of their hashes, so that no value's rows are gathered
    hashes = (F.xxhash64(*content), F.xxhash64(F.lit("again"), *content))
    found = part.frame.groupBy(*names).agg(F.count("*").alias("n"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(hashes)))
    found = found.select(*names, F.concat_ws(":", "n", "h0", "h1").alias("class"))
    weights = found.groupBy("class").agg(F.count("*").cast("double").alias("_w")).withColumnRenamed("class", name_of(own[0]))
    frame = part.frame.join(found, names).select(F.col("class").alias(name_of(own[0])), *(F.lit("").alias(n) for n in names[1:]), *content).distinct()
    return _Part(frame, part.variables, part.masks), found, weights


def keys(kb: KnowledgeBase, atoms: tuple[Atom, ...], bound: list[Var], wishes: dict[tuple[int, int], Wish] | None = None, masked: Masked | None = None) -> Keys:
    """The different bindings of ``bound`` in a join of connected atoms, with what is wished for columns (atom, position).

    ``masked`` gives a relation with its masks (:func:`with_masks`), where places are wished for.
    """
    wanted, parts, read = set(bound), [], {}
    uses = lambda i: {v for k, a in enumerate(atoms) if k != i for v in a.variables()}
    for i, atom in enumerate(atoms):
        own = {at: w for (k, at), w in (wishes or {}).items() if k == i}
        part, numbers = _atom(kb, atom, i, set(atom.variables()) & (wanted | uses(i)), own, masked)
        parts.append(part)
        read |= numbers
    parts = _eliminated(parts, wanted)
    classes, weights = [], []
    if len(parts) > 1 and not any(wanted <= p.variables for p in parts):
        for i, p in enumerate(parts):
            private = sorted((p.variables & wanted) - {v for k, q in enumerate(parts) if k != i for v in q.variables})
            if private:
                parts[i], table, weight = _classes(p, private)
                classes.append((private, table))
                weights.append((private[0], weight))
    # what is left is joined one after the other, cut to what is still needed
    order = ordered([Atom("", tuple(sorted(p.variables))) for p in parts])
    now = parts[order[0]]
    for n, i in enumerate(order[1:], 1):
        now = now.joined(parts[i]).cut(wanted | {v for j in order[n + 1 :] for v in parts[j].variables})
    now = now.cut(wanted)
    frame = now.frame.withColumn("w", F.lit(1.0))
    for v, weight in weights:
        frame = frame.join(weight, name_of(v)).withColumn("w", F.col("w") * F.col("_w")).drop("_w")
    return Keys(frame, classes, read)
