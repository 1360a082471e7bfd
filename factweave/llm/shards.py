"""Operator 4: sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions, racks and shards.  A row descends it: at each node every
child draws ``-ln(u) / weight``, with ``u`` from a hash of the row's key and the child's path and
the weight summed over the leaves below it, and the least draw is the way down.  The least of
exponential draws is a choice by weight, so each leaf gets its share, at the cost of the children
along one path only.

A draw depends on the row, the child's path and the child's weight.  A weight that changes
therefore moves rows between its own subtree and the rest at each level above it, and nowhere
else: the ways inside all other subtrees stay.  A further shard opens a region of its own, so that
rows only move into that shard.  (Put below an old region it would draw rows into that region, and
these could land on any shard there.)

The law is ``key``: the key and the tree decide, without looking at other rows.  Slots
are counted within each shard by input partition, so no task sees a whole shard.

Results: null texts have size 1 and the checksum of nothing, very long ones are measured like any
other; null keys form a key of their own; repeated rows share a shard and have slots of their own;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

#: Racks in a region and shards in a rack, by which shards that are numbered from 0 get their places.
RACKS, SHARDS = 2, 2


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int  # its number in the whole tree
    weight: float = 1.0


def tree(shards: int, weights: dict[int, float] | None = None, racks: int = RACKS, per_rack: int = SHARDS) -> list[Leaf]:
    """Shards 0 to ``shards - 1`` in their places, region by region."""
    weights = weights or {}
    return [Leaf(i // (racks * per_rack), i // per_rack % racks, i, weights.get(i, 1.0)) for i in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    return [*leaves, Leaf(max((x.region for x in leaves), default=-1) + 1, 0, len(leaves), weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw whose rate is the weight; 53 bits of the hash, never 0."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: the region of least draw, in it the rack, in it the shard."""

    def descend(options: dict[str, tuple[float, Column]]) -> Column:
        """What lies below the child of least draw; only that one is evaluated."""
        if len(options) == 1:
            return next(iter(options.values()))[1]
        draws = F.least(*(F.struct(_draw(key, path, weight).alias("draw"), F.lit(i).alias("child")) for i, (path, (weight, _)) in enumerate(options.items())))
        chosen, out = draws.getField("child"), None
        for i, (_, below) in enumerate(options.values()):
            out = F.when(chosen == i, below) if out is None else out.when(chosen == i, below)
        return out

    total = lambda inside: sum(x.weight for x in inside)
    regions = {}
    for region in sorted({x.region for x in leaves}):
        inside = [x for x in leaves if x.region == region]
        racks = {}
        for rack in sorted({x.rack for x in inside}):
            own = [x for x in inside if x.rack == rack]
            racks[f"region {region} rack {rack}"] = (total(own), descend({f"region {region} rack {rack} shard {x.shard}": (x.weight, F.lit(x.shard)) for x in own}))
        regions[f"region {region}"] = (total(inside), descend(racks))
    return descend(regions).cast("int")


def shard(documents: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row."""
    content = F.encode(text_of(text), "UTF-8")
    keyed = F.coalesce(F.col(key).cast("string"), F.lit("null key"))
    leaves = tree(shards, weights)
    rows = documents.select(
        F.col(key),
        (F.length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(keyed, leaves).alias("shard"),
        place(keyed, grown(leaves)).alias("grown_shard"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return with_slots(stage(rows, "shards"))


def with_slots(rows: DataFrame) -> DataFrame:
    """``slot``: gapless from 0 in each shard, in the order of partitions and their rows."""
    own = Window.partitionBy("shard", "_part").orderBy("_row")
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["shard", "_part"])
    columns = [c for c in rows.columns if c not in ("_part", "_row", "grown_shard")]
    return numbered.select(*columns, (F.col("_start") + F.col("_own")).cast("long").alias("slot"), "grown_shard")
