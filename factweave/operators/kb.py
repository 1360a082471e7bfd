"""Knowledge bases: named relations of fixed arity, sets of tuples of symbols.

A relation is a DataFrame with string columns ``c0 .. c{n-1}``; duplicates and rows with
nulls do not enter.  Nothing here collects data: the catalogue (names, arities) is on the
driver, everything else stays a plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .grouped import Grouped, Halved


class KbError(ValueError):
    """A name is unknown or taken, or an arity does not fit."""


def columns(arity: int, prefix: str = "c") -> list[str]:
    return [f"{prefix}{i}" for i in range(arity)]


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A table in the shared folder instead of a plan; see :func:`sources.shared.written`."""
    return written(df)


def counted(frames: dict[str, DataFrame], sizes: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Rows of several frames, in one job; ``sizes`` are tables of one row, ``n``, of what need not be counted row by row."""
    rows = {name: df.agg(F.count("*").alias("n")) for name, df in frames.items()} | (sizes or {})
    if not rows:
        return {}
    return {r["rel"]: r["n"] for r in union(df.select(F.lit(name).alias("rel"), "n") for name, df in rows.items()).collect()}


#: Changed records of one relation that the driver gathers before they become part of its plan.
STAGED_ROWS = 10_000
#: Changes that a relation's plan nests before it is written out.
MOST_CHANGES = 4


class KnowledgeBase:
    """Relations by name.

    Records that are given one by one are gathered on the driver, the last word on each counting, and join the plan
    together when the relation is next read or ``STAGED_ROWS`` are at hand.  After ``MOST_CHANGES`` such steps the relation is written out.
    """

    def __init__(self, spark: SparkSession, name: str = "kb"):
        self.spark, self.name = spark, name
        self.arities: dict[str, int] = {}
        self._frames: dict[str, DataFrame] = {}
        self._entailed: dict[str, DataFrame] = {}
        self._staged: dict[str, dict[tuple[str, ...], bool]] = {}
        self._removed: dict[str, set[tuple[str, ...]]] = {}  # staged removals, also of records that were added again
        self._changes: dict[str, int] = {}
        self.where: dict[str, str] = {}  # the condition that tells entailed facts, where one does
        self.grouped: dict[str, Grouped] = {}  # relations that hold between groups of symbols, as long as nothing changes them
        self.halved: dict[str, Halved] = {}  # the same for relations of which a rule restores the other half
        self._held: set[str] = set()  # those of grouped that are in the shared folder
        self.marks: dict[str, tuple[Grouped, DataFrame | None]] = {}  # what is entailed of a relation kept by groups: by groups, and more facts

    @property
    def frames(self) -> dict[str, DataFrame]:
        self._settle_all()
        return self._frames

    @property
    def entailed(self) -> dict[str, DataFrame]:
        self._settle_all()
        return self._entailed

    # -- catalogue ---------------------------------------------------------------------

    def _schema(self, arity: int) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in columns(arity)])

    def create(self, name: str, arity: int) -> None:
        if name in self.arities:
            raise KbError(f"relation {name} exists")
        if arity < 1:
            raise KbError("a relation has one column at least")
        self.arities[name] = arity
        self.frames[name] = self.spark.createDataFrame([], self._schema(arity))

    def attach(self, name: str, df: DataFrame, known_set: bool = False) -> KnowledgeBase:
        """A DataFrame as a relation, its columns in order; null rows and duplicates go.

        A ``known_set`` holds neither, which saves the shuffle that finds duplicates.
        """
        if name in self.arities:
            raise KbError(f"relation {name} exists")
        self.arities[name] = len(df.columns)
        self.frames[name] = self._facts(name, df, known_set)
        return self

    def attach_mates(self, name: str, members: DataFrame, loops: bool = False) -> KnowledgeBase:
        """All pairs of different values that have a class in common, from columns value and class; with ``loops`` each also with itself.

        The relation is kept by groups (:mod:`operators.grouped`); its pairs are made where they are read.
        """
        pairs = Grouped.mates(members.toDF("val", "cls").select(*(F.col(c).cast("string") for c in ("val", "cls"))), loops)
        return self.attach_grouped(name, pairs)

    def attach_grouped(self, name: str, facts: Grouped | Halved) -> KnowledgeBase:
        """A binary relation that is known by groups of symbols."""
        self.attach(name, facts.pairs(), known_set=True)
        (self.grouped if isinstance(facts, Grouped) else self.halved)[name] = facts
        return self

    def groups_of(self, name: str) -> Grouped:
        """The groups of a relation that is kept by groups, written once, so that what is made of them has a small plan."""
        if name not in self._held:
            self.grouped[name] = self.grouped[name].written()
            self._held.add(name)
        return self.grouped[name]

    def attach_rows(self, name: str, rows: Iterable[Iterable[str]], arity: int | None = None) -> KnowledgeBase:
        data = [tuple(map(str, r)) for r in rows]
        arity = arity or len(data[0])
        if any(len(r) != arity for r in data):
            raise KbError(f"rows of {name} differ in arity")
        return self.attach(name, self.spark.createDataFrame(data, self._schema(arity)))

    def _facts(self, name: str, df: DataFrame, known_set: bool = False) -> DataFrame:
        if len(df.columns) != self.arities[name]:
            raise KbError(f"{name} has arity {self.arities[name]}, not {len(df.columns)}")
        names = columns(len(df.columns))
        out = df.toDF(*names).select(*(F.col(c).cast("string").alias(c) for c in names))
        return out if known_set else out.dropna().dropDuplicates()

    def delete(self, name: str) -> None:
        self._known(name)
        for d in (self._frames, self.arities, self._entailed, self._staged, self._removed, self._changes, self.grouped, self.halved, self.marks, self.where):
            d.pop(name, None)
        self._held.discard(name)

    def _known(self, name: str) -> None:
        if name not in self.arities:
            raise KbError(f"no relation {name}")

    def has(self, name: str) -> bool:
        return name in self.arities

    def arity(self, name: str) -> int:
        """0 if there is no such relation."""
        return self.arities.get(name, 0)

    def __getitem__(self, name: str) -> DataFrame:
        self._known(name)
        return self.frames[name]

    @property
    def names(self) -> list[str]:
        return sorted(self.arities)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> KnowledgeBase:
        for name in self.names:
            if name not in self.grouped and name not in self.halved:  # pairs are made again rather than kept
                self.frames[name] = self.frames[name].persist(level)
        return self

    def unpersist(self) -> None:
        for df in self.frames.values():
            df.unpersist()

    # -- records -----------------------------------------------------------------------

    def _records(self, name: str, records: DataFrame | Iterable[Iterable[str]]) -> DataFrame:
        self._known(name)
        if isinstance(records, DataFrame):
            return self._facts(name, records)
        rows = [tuple(map(str, r)) for r in records]
        if any(len(r) != self.arities[name] for r in rows):
            raise KbError(f"{name} has arity {self.arities[name]}")
        return self.spark.createDataFrame(rows, self._schema(self.arities[name])).dropDuplicates()

    def _stage(self, name: str, records: Iterable[Iterable[str]], kept: bool) -> None:
        self._known(name)
        rows = [tuple(map(str, r)) for r in records]
        if any(len(r) != self.arities[name] for r in rows):
            raise KbError(f"{name} has arity {self.arities[name]}")
        staged = self._staged.setdefault(name, {})
        for r in rows:
            staged[r] = kept
            if not kept:
                self._removed.setdefault(name, set()).add(r)
        if len(staged) > STAGED_ROWS:
            self._settle(name)

    def _settle(self, name: str) -> None:
        """Staged records join the plan: what changed leaves the relation, and what is kept of it comes back."""
        staged, removed = self._staged.pop(name, {}), self._removed.pop(name, set())
        if not staged:
            return
        on = columns(self.arities[name])
        schema = T.StructType([*self._schema(self.arities[name]).fields, T.StructField("_kept", T.BooleanType())])
        last = self.spark.createDataFrame([(*r, kept) for r, kept in staged.items()], schema)
        kept = last.filter("_kept").drop("_kept")
        self._change(name, self._frames[name].join(last.drop("_kept"), on, "left_anti").unionByName(kept))
        if removed and name in self._entailed:
            gone = self.spark.createDataFrame(sorted(removed), self._schema(self.arities[name]))
            self._entailed[name] = self._entailed[name].join(gone, on, "left_anti")

    def _settle_all(self) -> None:
        for name in list(self._staged):
            self._settle(name)

    def _change(self, name: str, df: DataFrame) -> None:
        for d in (self.grouped, self.halved, self.marks, self.where):
            d.pop(name, None)
        self._held.discard(name)
        n = self._changes.get(name, 0) + 1
        if n >= MOST_CHANGES:
            df, n = cut_lineage(df), 0
            if name in self._entailed:
                self._entailed[name] = cut_lineage(self._entailed[name])
        self._frames[name], self._changes[name] = df, n

    def add(self, name: str, records: DataFrame | Iterable[Iterable[str]]) -> None:
        """Adds records; those that are there already change nothing."""
        if isinstance(records, DataFrame):
            new = self._records(name, records)
            self._settle(name)
            self._change(name, self._frames[name].unionByName(new).dropDuplicates())
        else:
            self._stage(name, records, True)

    def remove(self, name: str, records: DataFrame | Iterable[Iterable[str]]) -> None:
        """Removes records; missing ones are no error.  Entailment goes with them."""
        if not isinstance(records, DataFrame):
            self._stage(name, records, False)
            return
        gone, on = self._records(name, records), columns(self.arities[name])
        self._settle(name)
        if name in self._entailed:
            self._entailed[name] = self._entailed[name].join(gone, on, "left_anti")
        self._change(name, self._frames[name].join(gone, on, "left_anti"))

    def contains(self, name: str, records: DataFrame | Iterable[Iterable[str]]) -> DataFrame:
        """The given records with ``present``."""
        on = columns(self.arities[name])
        asked = self._records(name, records)
        return asked.join(self[name].withColumn("present", F.lit(True)), on, "left").select(*on, F.coalesce("present", F.lit(False)).alias("present"))

    def entail(self, name: str, records: DataFrame | Iterable[Iterable[str]]) -> None:
        """Marks records as entailed, where they are in the relation."""
        found = self._records(name, records).join(self[name], columns(self.arities[name]), "left_semi")
        old = self.entailed.get(name)
        for d in (self.marks, self.where):
            d.pop(name, None)
        self.entailed[name] = found if old is None else old.unionByName(found).dropDuplicates()

    def entail_where(self, name: str, condition: str) -> None:
        """Marks the facts that fit a condition on ``c0, c1, ..``, as SQL; the first marks of a relation need no join with it."""
        found = self[name].filter(condition)
        if name in self.entailed:
            self.entail(name, found)
        else:
            self.mark(name, found)
            self.where[name] = condition

    def mark(self, name: str, found: DataFrame) -> None:
        """Marks facts that are in the relation, each once, and are not marked yet."""
        old = self.entailed.get(name)
        self.where.pop(name, None)
        if name in self.marks:
            groups, more = self.marks[name]
            self.marks[name] = groups, found if more is None else more.unionByName(found)
        self.entailed[name] = found if old is None else old.unionByName(found)

    def mark_groups(self, name: str, found: Grouped) -> None:
        """Marks facts of a relation that is kept by groups and has no marks yet."""
        self.mark(name, found.pairs())
        self.marks[name] = found, None

    def marked(self, name: str) -> DataFrame:
        """The relation with ``is_old``: whether a fact is entailed already."""
        old = self.entailed.get(name)
        if old is None:
            return self[name].withColumn("is_old", F.lit(False))
        return self[name].join(old.withColumn("_old", F.lit(True)), columns(self.arities[name]), "left").withColumn("is_old", F.col("_old").isNotNull()).drop("_old")

    def not_entailed(self, name: str) -> DataFrame:
        old = self.entailed.get(name)
        if name in self.marks and name in self.grouped:
            groups, old = self.marks[name]
            left = self.groups_of(name).minus(groups).written().pairs()
        else:
            left = self[name]
        return left if old is None else left.join(old, columns(self.arities[name]), "left_anti")

    def size(self, name: str) -> DataFrame:
        """One row, ``n``: the facts of a relation."""
        frame = self[name]  # first, as reading it takes in what is staged
        known = self.grouped.get(name) or self.halved.get(name)
        return frame.agg(F.count("*").alias("n")) if known is None else known.count()

    def sizes(self) -> dict[str, int]:
        """The facts of each relation, counted in one job."""
        return counted({}, {n: self.size(n) for n in self.names})

    # -- views -------------------------------------------------------------------------

    def facts(self, names: Iterable[str] | None = None) -> DataFrame:
        """All facts, or those of some relations, in one table: ``rel`` and ``args``."""
        return self._facts_of(self.names if names is None else names)

    def _facts_of(self, names: Iterable[str]) -> DataFrame:
        return union(self[n].select(F.lit(n).alias("rel"), F.array(*columns(self.arities[n])).alias("args")) for n in names)

    def cells(self) -> DataFrame:
        """``rel, arity, pos, val``: one row for each argument of each fact."""
        return self._cells(self.names)

    def _cells(self, names: Iterable[str]) -> DataFrame:
        return self._facts_of(names).select("rel", F.size("args").alias("arity"), F.posexplode("args").alias("pos", "val"))

    def values(self) -> DataFrame:
        """``rel, pos, val``: one row for each different value of each column, found relation by relation."""
        self._settle_all()
        return self._values(self.names)

    def _values(self, names: Iterable[str]) -> DataFrame:
        each = lambda n: F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.col(c).alias("val")) for i, c in enumerate(columns(self.arities[n])))))
        whole = lambda n: self.grouped[n].values().select(F.lit(n).alias("rel"), "pos", "val")
        return union(whole(n) if n in self.grouped else self[n].select(F.lit(n).alias("rel"), each(n).alias("x")).select("rel", "x.pos", "x.val") for n in names)

    def value_counts(self) -> DataFrame:
        """``rel, pos, val, n``: facts of each value of each column."""
        self._settle_all()
        plain = [n for n in self.names if n not in self.grouped]
        parts = [self.grouped[n].value_counts().select(F.lit(n).alias("rel"), "pos", "val", "n") for n in self.names if n in self.grouped]
        if plain:
            parts.append(self._cells(plain).groupBy("rel", "pos", "val").agg(F.count("*").alias("n")))
        return union(parts)

    def domains(self) -> DataFrame:
        """``rel, pos, val``: the different values of each column."""
        return self.values().distinct()

    def constants(self) -> DataFrame:
        """``val``: all symbols of the facts."""
        self._settle_all()
        parts = [self.halved[n].constants() for n in self.names if n in self.halved]
        rest = [n for n in self.names if n not in self.halved]
        if rest:
            parts.append(self._values(rest).select("val"))
        return union(parts).distinct()

    def numeration(self, names_too: bool = True) -> DataFrame:
        """``name, num``: symbols (and relation names) numbered from 1 in their order.

        The order is global and so are the numbers: sorted runs are counted by range, and
        each run adds the counts before it, so that no task sees all symbols.
        """
        symbols = self.constants().select(F.col("val").alias("name"))
        if names_too:
            symbols = symbols.unionByName(self.spark.createDataFrame([(n,) for n in self.names], "name string"))
        return numbered(symbols.distinct(), "name", "num")

    def encoded(self, name: str, numbers: DataFrame) -> DataFrame:
        """The relation with symbols replaced by their numbers."""
        out = self[name]
        known = self.grouped.get(name) or self.halved.get(name)
        if known is not None:
            return known.encoded(numbers.select(F.col("name").alias("val"), "num")).pairs()
        for c in columns(self.arities[name]):
            out = out.join(numbers.select(F.col("name").alias(c), F.col("num").alias(f"_{c}")), c).drop(c)
        return out.select(*(F.col(f"_{c}").alias(c) for c in columns(self.arities[name])))

    def decoded(self, df: DataFrame, numbers: DataFrame) -> DataFrame:
        names = df.columns
        for c in names:
            df = df.join(numbers.select(F.col("num").alias(c), F.col("name").alias(f"_{c}")), c).drop(c)
        return df.select(*(F.col(f"_{c}").alias(c) for c in names))


def numbered(df: DataFrame, by: str, number: str) -> DataFrame:
    """``df`` with dense numbers from 1 in the order of ``by``, which is unique."""
    ranged = cut_lineage(df.repartitionByRange(by).sortWithinPartitions(by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first") + 1).alias(number))


def take_number(used: Iterable[int]) -> int:
    """The smallest number from 1 that is free."""
    taken, n = set(used), 1
    while n in taken:
        n += 1
    return n


class NameMap:
    """A small dictionary on the driver: names to numbers and back, the smallest free number first."""

    def __init__(self, names: Iterable[str] = ()):
        self.to_num: dict[str, int] = {}
        self.to_name: dict[int, str] = {}
        self.freed: list[int] = []  # a heap of numbers that were given and came back
        for n in names:
            self.map(n)

    def map(self, name: str) -> int:
        if name not in self.to_num:
            num = heapq.heappop(self.freed) if self.freed else len(self.to_num) + 1
            self.to_num[name], self.to_name[num] = num, name
        return self.to_num[name]

    def unmap(self, name: str) -> int:
        """The number that becomes free, 0 if the name is unknown."""
        num = self.to_num.pop(name, 0)
        if num:
            del self.to_name[num]
            heapq.heappush(self.freed, num)
        return num

    def unmap_number(self, num: int) -> str | None:
        name = self.to_name.get(num)
        if name is not None:
            self.unmap(name)
        return name

    def __len__(self) -> int:
        return len(self.to_num)

    def items(self):
        return sorted(self.to_name.items())
