"""Binary relations that hold between whole groups of symbols.

Each pair of suppliers of one nation is a fact of ``supp_peer``, so its facts are as many as the squares of the nations,
while nations are few.  Such a relation is kept as the group of each symbol and the pairs of groups that are linked.
Counts, domains and the relation's meeting with others follow from these; the pairs themselves are made only where somebody
reads them, by blocks of values spread over all tasks, without a shuffle of pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values in a block, about; two blocks are crossed at once.
BLOCK = 256


def _id(*parts) -> F.Column:
    return F.md5(F.to_json(F.struct(*parts)))


@dataclass
class Grouped:
    """``groups`` (val, grp) has each value once; ``links`` (s, t, off, diag) each pair of groups once.

    ``off``: all pairs of a value of s and a different one of t; ``diag``, where s is t: each value with itself.
    """

    groups: DataFrame
    links: DataFrame

    @classmethod
    def mates(cls, members: DataFrame, loops: bool = False) -> Grouped:
        """Pairs of values that have a class in common, from ``val, cls``; with ``loops`` each also with itself.

        A group is the values of equal sets of classes, so a value in several classes makes no pair twice.
        """
        held = members.dropna().groupBy("val").agg(F.sort_array(F.collect_set("cls")).alias("at")).select("val", "at", _id("at").alias("grp"))
        at = held.select("grp", F.explode("at").alias("cls")).distinct()
        links = at.withColumnRenamed("grp", "s").join(at.withColumnRenamed("grp", "t"), "cls").select("s", "t").distinct()
        return cls(held.select("val", "grp"), links.select("s", "t", F.lit(True).alias("off"), ((F.col("s") == F.col("t")) & F.lit(loops)).alias("diag")))

    @classmethod
    def regrouped(cls, groups: DataFrame, links: DataFrame) -> Grouped:
        """From groups in which a value may stand several times, and links that may be there several times."""
        held = groups.groupBy("val").agg(F.sort_array(F.collect_set("grp")).alias("at")).select("val", "at", _id("at").alias("grp"))
        parts = held.select("grp", F.explode("at").alias("old")).distinct()
        joined = _relinked(links.groupBy("s", "t").agg(F.bool_or("off").alias("off"), F.bool_or("diag").alias("diag")), parts, parts)
        joined = joined.groupBy("s", "t").agg(F.bool_or("off").alias("off"), F.bool_or("diag").alias("diag")).filter("off OR diag")
        return cls(held.select("val", "grp"), joined)

    def _sizes(self, name: str, n: str) -> DataFrame:
        return self.groups.groupBy(F.col("grp").alias(name)).agg(F.count("*").alias(n))

    def _sized(self) -> DataFrame:
        """The links with the number of pairs of each."""
        same = F.col("s") == F.col("t")
        off = F.when(F.col("off"), F.col("n_s") * F.col("n_t") - F.when(same, F.col("n_s")).otherwise(0)).otherwise(0)
        return self.links.join(self._sizes("s", "n_s"), "s").join(self._sizes("t", "n_t"), "t").withColumn("pairs", off + F.when(F.col("diag"), F.col("n_s")).otherwise(0))

    def count(self) -> DataFrame:
        """One row, ``n``."""
        return self._sized().agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"))

    def swapped(self) -> Grouped:
        return Grouped(self.groups, self.links.select(F.col("t").alias("s"), F.col("s").alias("t"), "off", "diag"))

    def value_counts(self) -> DataFrame:
        """``pos, val, n``: facts of each value of each column."""
        each = self._sized().filter("pairs > 0")
        per = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("s").alias("grp"), F.col("n_s").alias("size")), F.struct(F.lit(1).alias("pos"), F.col("t").alias("grp"), F.col("n_t").alias("size"))))
        # all values of a group have the same number of facts
        per = each.select(per.alias("x"), "pairs").groupBy("x.pos", "x.grp").agg((F.sum("pairs") / F.max("x.size")).cast("long").alias("n"))
        return self.groups.join(per, "grp").select("pos", "val", "n")

    def values(self) -> DataFrame:
        """``pos, val``: the different values of each column."""
        return self.value_counts().select("pos", "val")

    def loops(self) -> DataFrame:
        """``val``: values that stand with themselves."""
        return self.groups.join(self.links.filter("diag").select(F.col("s").alias("grp")), "grp", "left_semi").select("val")

    def pairs(self) -> DataFrame:
        """``c0, c1``: all facts, each once."""
        return self._made(self.groups, F.col("val"), lambda item: item)

    def lesser(self) -> DataFrame:
        """``c0, c1``: of each fact and its exchange, both facts here, the one whose first value is the lesser as JSON; values with themselves, too.

        Where ``groups`` has a column ``key``, that is compared instead.
        """
        keyed = self.groups if "key" in self.groups.columns else self.groups.withColumn("key", F.to_json(F.array("val")))
        return self._made(keyed, F.struct("val", "key"), lambda item: item["val"], lambda a, b: a["key"] <= b["key"])

    def _made(self, groups: DataFrame, item: F.Column, val: Callable, keep: Callable | None = None) -> DataFrame:
        sized = groups.join(self._sizes("grp", "n"), "grp")
        blocks = sized.groupBy("grp", F.pmod(F.xxhash64("val"), F.ceil(F.col("n") / BLOCK)).alias("at")).agg(F.collect_list(item).alias("block"))
        side = lambda grp, at, block: blocks.select(F.col("grp").alias(grp), F.col("at").alias(at), F.col("block").alias(block))
        crossed = self.links.filter("off").join(side("s", "at_s", "left"), "s").join(side("t", "at_t", "right"), "t")
        # few bytes make many pairs, so tasks are not to be chosen by bytes
        tasks = int(self.groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = crossed.repartition(tasks, "s", "at_s", "t", "at_t").select(F.explode("left").alias("a"), "right", "diag")
        made = spread.select("a", F.explode("right").alias("b"), "diag")
        a, b = F.col("a"), F.col("b")
        fits = (val(a) != val(b)) | F.col("diag")
        made = made.filter(fits if keep is None else fits & keep(a, b)).select(val(a).alias("c0"), val(b).alias("c1"))
        # groups of which each value stands with itself only are not crossed
        alone = self.groups.join(self.links.filter("diag AND NOT off").select(F.col("s").alias("grp")), "grp", "left_semi")
        return made.unionByName(alone.select(F.col("val").alias("c0"), F.col("val").alias("c1")))

    def encoded(self, numbers: DataFrame) -> Grouped:
        """With numbers (``val, num``) in the place of values, which keep their order for :meth:`lesser`."""
        return Grouped(self.groups.withColumn("key", F.to_json(F.array("val"))).join(numbers, "val").select(F.col("num").alias("val"), "grp", "key"), self.links)

    def written(self) -> Grouped:
        """The same as two small tables in the shared folder instead of plans; see :func:`sources.shared.written`."""
        return Grouped(written(self.groups, "groups"), written(self.links, "links"))

    def lesser_count(self) -> DataFrame:
        """One row, ``n``: the facts of :meth:`lesser`."""
        loops = F.when(F.col("diag"), F.col("n_s")).otherwise(0)
        return self._sized().agg(F.coalesce(F.sum((F.col("pairs") + loops) / 2), F.lit(0)).cast("long").alias("n"))

    def holding(self, df: DataFrame, a: str, b: str) -> DataFrame:
        """Rows of ``df`` whose values in ``a`` and ``b`` are a fact."""
        known = lambda c, grp: self.groups.select(F.col("val").alias(c), F.col("grp").alias(grp))
        fits = F.when(F.col(a) == F.col(b), F.col("_diag")).otherwise(F.col("_off"))
        links = self.links.select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("off").alias("_off"), F.col("diag").alias("_diag"))
        return df.join(known(a, "_s"), a).join(known(b, "_t"), b).join(links, ["_s", "_t"]).filter(fits).select(*df.columns)

    def restricted(self, left: DataFrame | None, right: DataFrame | None) -> Grouped:
        """The pairs whose first value is in ``left`` and whose second is in ``right`` (``val``)."""
        groups = self.groups
        for side, keys in (("l", left), ("r", right)):
            groups = groups.withColumn(side, F.lit(True)) if keys is None else groups.join(keys.select("val", F.lit(True).alias(side)), "val", "left").withColumn(side, F.coalesce(side, F.lit(False)))
        groups = groups.filter("l OR r").select("val", F.col("grp").alias("old"), "l", "r", _id(F.col("grp"), "l", "r").alias("grp"))
        parts = groups.select("old", "grp", "l", "r").distinct()
        return Grouped(groups.select("val", "grp"), _relinked(self.links, parts.filter("l"), parts.filter("r")))

    def _beside(self, other: Grouped) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Groups that are finer than those of both, and the links of either between them."""
        groups = self.groups.withColumnRenamed("grp", "one").join(other.groups.withColumnRenamed("grp", "two"), "val", "full").withColumn("grp", _id("one", "two"))
        parts = groups.select("one", "two", "grp").distinct()
        of = lambda name, links: _relinked(links, *[parts.select(F.col(name).alias("old"), "grp").dropna()] * 2)
        return groups.select("val", "grp"), of("one", self.links), of("two", other.links)

    def met(self, other: Grouped) -> Grouped:
        """The facts of both."""
        groups, a, b = self._beside(other)
        b = b.select("s", "t", F.col("off").alias("off2"), F.col("diag").alias("diag2"))
        return Grouped(groups, a.join(b, ["s", "t"]).select("s", "t", (F.col("off") & F.col("off2")).alias("off"), (F.col("diag") & F.col("diag2")).alias("diag")))

    def minus(self, other: Grouped) -> Grouped:
        """The facts that are none of the other's."""
        groups, a, b = self._beside(other)
        b = b.select("s", "t", F.col("off").alias("off2"), F.col("diag").alias("diag2"))
        lacks = lambda c: F.col(c) & ~F.coalesce(f"{c}2", F.lit(False))
        # a group of one value has no pair of different ones
        n = groups.groupBy(F.col("grp").alias("s")).agg(F.count("*").alias("n"))
        left = a.join(b, ["s", "t"], "left").join(n, "s").select("s", "t", (lacks("off") & ((F.col("s") != F.col("t")) | (F.col("n") > 1))).alias("off"), lacks("diag").alias("diag"))
        return Grouped(groups, left.filter("off OR diag"))

    def mirrored(self) -> Grouped:
        """The facts whose exchange is a fact, too."""
        back = self.links.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("off").alias("off2"))
        return Grouped(self.groups, self.links.join(back, ["s", "t"]).select("s", "t", (F.col("off") & F.col("off2")).alias("off"), "diag").filter("off OR diag"))

    def then(self, other: Grouped) -> Grouped:
        """Pairs x, y with some z so that x, z is a fact here and z, y one of ``other``."""
        groups, a, b = self._beside(other)
        n = groups.groupBy(F.col("grp").alias("u")).agg(F.count("*").alias("n"))
        first = a.select("s", F.col("t").alias("u"), F.col("off").alias("off1"), F.col("diag").alias("diag1"))
        second = b.select(F.col("s").alias("u"), "t", F.col("off").alias("off2"), F.col("diag").alias("diag2"))
        on = lambda x, y: (F.col(x) == F.col(y)).cast("long")
        both, same = F.col("off1") & F.col("off2"), F.col("s") == F.col("t")
        # z that is neither x nor y, z that is x, z that is y; then the same for x that is y
        off = (both & (F.col("n") > on("u", "s") + on("u", "t"))) | (F.col("diag1") & F.col("off2")) | (F.col("off1") & F.col("diag2"))
        diag = same & ((both & (F.col("n") > on("u", "s"))) | (F.col("diag1") & F.col("diag2")))
        links = first.join(second, "u").join(n, "u").groupBy("s", "t").agg(F.bool_or(off).alias("off"), F.bool_or(diag).alias("diag"))
        return Grouped(groups, links.filter("off OR diag"))

    def hop(self, df: DataFrame, z: str, x: str) -> DataFrame:
        """``df`` with ``z`` replaced by each ``x`` that stands before it in a fact, without duplicates."""
        kept = [c for c in df.columns if c != z]
        seen = df.join(self.groups.select(F.col("val").alias(z), F.col("grp").alias("t")), z)
        # what a group's values stand beside; a value is not one that stands before itself, unless the group says so
        ends = seen.groupBy("t", *kept).agg(F.min(z).alias("_least"), F.max(z).alias("_most"))
        first = self.groups.select(F.col("val").alias(x), F.col("grp").alias("s"))
        off = first.join(self.links.filter("off").select("s", "t"), "s").join(ends, "t").filter((F.col("_least") != F.col(x)) | (F.col("_most") != F.col(x))).select(x, *kept)
        diag = seen.join(self.links.filter("diag").select("t"), "t", "left_semi").select(F.col(z).alias(x), *kept)
        return off.unionByName(diag).distinct()


@dataclass
class Halved:
    """The facts of ``rest`` and, of each two facts of ``mirror`` that are each other's exchange, the lesser (:meth:`Grouped.lesser`).

    That is what is left of a relation under ``p(X,Y):-p(Y,X)``; all exchanges of ``mirror`` are facts of it.
    """

    rest: Grouped
    mirror: Grouped

    def pairs(self) -> DataFrame:
        return self.rest.pairs().unionByName(self.mirror.lesser())

    def count(self) -> DataFrame:
        """One row, ``n``."""
        return self.rest.count().unionByName(self.mirror.lesser_count()).agg(F.sum("n").alias("n"))

    def constants(self) -> DataFrame:
        """``val``: the symbols; either of two exchanged facts holds both of theirs."""
        return self.rest.values().select("val").unionByName(self.mirror.values().select("val"))

    def whole(self) -> Grouped:
        """The facts together with the exchanges of the mirror's."""
        groups, a, b = self.rest._beside(self.mirror)
        links = a.unionByName(b).groupBy("s", "t").agg(F.bool_or("off").alias("off"), F.bool_or("diag").alias("diag"))
        return Grouped(groups, links)

    def encoded(self, numbers: DataFrame) -> Halved:
        return Halved(self.rest.encoded(numbers), self.mirror.encoded(numbers))

    def written(self) -> Halved:
        return Halved(self.rest.written(), self.mirror.written())


def _relinked(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Links between parts (``grp``) of the groups (``old``) that they were between."""
    ends = links.withColumnRenamed("s", "_s").withColumnRenamed("t", "_t")
    ends = ends.join(left.select(F.col("old").alias("_s"), F.col("grp").alias("s")), "_s").join(right.select(F.col("old").alias("_t"), F.col("grp").alias("t")), "_t")
    return ends.select("s", "t", "off", (F.col("diag") & (F.col("s") == F.col("t"))).alias("diag"))


def between(left: DataFrame, right: DataFrame, links: DataFrame) -> Grouped:
    """From the classes of first and second values (``val, cls``) and the pairs of classes (``s, t``) whose values stand together."""
    groups = left.withColumnRenamed("cls", "one").join(right.withColumnRenamed("cls", "two"), "val", "full").withColumn("grp", _id("one", "two"))
    parts = groups.select("one", "two", "grp").distinct()
    whole = links.select("s", "t", F.lit(True).alias("off"), F.lit(True).alias("diag"))
    of = lambda name: parts.select(F.col(name).alias("old"), "grp").dropna()
    return Grouped(groups.select("val", "grp"), _relinked(whole, of("one"), of("two")))
