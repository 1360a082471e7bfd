"""Operator 5: near-duplicate groups of SimHash fingerprints, by covering locality-sensitive hashing.

Equal fingerprints are one node.  Each of the 64 bits has a code in {1..7}; table v of the
seven tables keeps the bits whose code has an odd number of bits in common with v.  Two or
fewer differing bits have codes for which some v has none in common, so such a pair agrees
in that whole table: nothing within the radius is missed.

A bucket of two is compared.  Fingerprints of larger buckets are linked through the points
within one bit of them: two fingerprints differ in at most two bits exactly if they share
such a point, and a point has at most 65 fingerprints, so no bucket is expanded into pairs.

Results: a null or empty text has fingerprint zero and is linked like any other; an empty table
gives an empty one; other columns stay, whatever their names; a text of fewer words than a shingle
is one shingle, a very long one is hashed in pieces; repeated rows get a row each; rows without an id
get fingerprint and component like others, but never name a component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, boxed, spread_join, stage, text_of, text_slices, unboxed
from .components import components

SHINGLE, RADIUS, BITS, SEED = 3, 2, 64, 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.array([len(w) for w in words]) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``documents`` and ``fp``, the fingerprint as a signed long."""
    kept = ["doc_id"] if keep is None else keep
    rows = documents.select(*kept, text_of().alias("_text"))
    schema = f"{', '.join(f'`{c}` {t}' for c, t in rows.drop('_text').dtypes)}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                found = np.array([fingerprint(t) for t in part.column("_text").to_pylist()], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found)], names=[*kept, "fp"])

    return rows.mapInArrow(run, schema)


def masks() -> list[int]:
    """For each table the bits that it keeps."""
    code = [1 + i % 7 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (code[i] & v).bit_count() % 2) for v in range(1, 8)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect exactly the fingerprints (column ``fp``, each once) linked at RADIUS bits."""
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks()))))
    rows = nodes.select("fp", tables.alias("x")).select("fp", "x.t", "x.key")
    buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    pairs = buckets.filter("n = 2").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")
    crowded = rows.join(buckets.filter("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    points = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS))))
    around = crowded.select("fp", points.alias("point"))
    near = around.groupBy("point").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return pairs.unionByName(near.select(F.explode("all").alias("u"), "v").filter("u <> v")).distinct()


def groups(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``found`` with ``component_id``, the smallest id of their component.

    ``found`` has ``fp`` and the id; it should be staged, since it is read more than once.
    """
    nodes = found.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.select("fp", "n", "root").join(least, "root").select("fp", "n", "component_id"), "named")
    return spread_join(found, named, "fp")  # one fingerprint may have any share of the rows


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every document."""
    found = stage(fingerprints(documents), "simhash", compact=True)
    return groups(found).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each group: the first by id, then by place; rows without an id come last."""
    rows = boxed(documents)
    found = stage(fingerprints(rows, ["doc_id", "_rid"]), "simhash", compact=True)
    nodes = groups(found)
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_rid").alias("c"))
    # the component's name may be null where no row has an id; its members then share a fingerprint
    key = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), F.col("fp").cast("string")))
    first = nodes.groupBy(key.alias("k")).agg(F.min(rank).alias("first")).select(F.col("first.c").alias("_rid"))
    others = found.select("_rid").join(first, "_rid", "left_anti")
    return unboxed(attached(rows, others, "near-copies", "left_anti"))
