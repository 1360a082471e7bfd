"""Operator 2: exact top-k search by inner product, columnar branch and bound.

Candidates are packed into blocks, stored dimension by dimension with the mass of each group of
dimensions.  A query takes the groups of a block in the order of its own mass: after each group a
candidate's score can grow by no more than the product of the two remaining norms
(Cauchy-Schwarz), and candidates whose bound falls below the query's floor are compacted away.
The floor is the k-th best score so far; it begins with the k-th best among a bounded sample of
all candidates, which a first pass over the queries finds.

A candidate block is sent to its task once, and the query blocks are streamed past it: a task
holds one of each.  The best k of every block are then reduced by query.

Scores are exact integers: float64 holds them while the squared norms stay below 2^52; of vectors beyond
that Python integers are used, row by row, and only of these.  Results: vectors that are null or hold null or
non-finite components take no part, as query or candidate; neither do rows without an
id.  A shorter vector counts as padded with zeros, a long one takes more memory by its
length only.  Rows with equal ids are candidates each; a query's own id is no candidate.
Ties go to the smaller id.  An empty table gives an empty one.  Other columns, whatever their
names, are not read.  Components beyond 1e300 count as 1e300, and scores beyond 64 bits as the greatest or
least number of 64 bits, by which they are ranked.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bytes of a query block, and of a candidate block at most; smaller ones where there are few rows, so that all cores work.
QUERY_BLOCK, CANDIDATE_BLOCK = 256 << 10, 16 << 20
#: Dimensions taken at a time; rows of the sample that gives the first floors.
DIMENSIONS, SEED_ROWS = 8, 4096
_EXACT = float(1 << 52)


def vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows of ``id, v`` packed into blocks of ``size`` bytes: ``ids`` (int64), ``data`` (float64, row-major), ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = np.empty(0, np.int64), np.empty((0, 0))
        for batch in chain(batches, (None,)):
            if batch is not None and batch.num_rows:
                ids = np.concatenate((ids, batch.column("id").to_numpy()))
                data = stacked(data, matrix(batch.column("v")))
            rows = max(1, size // max(8, 8 * data.shape[1]))
            while len(ids) >= rows or batch is None and len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[:rows].astype("<i8").tobytes()]), pa.array([np.ascontiguousarray(data[:rows], "<f8").tobytes()]), pa.array([data.shape[1]], pa.int32())],
                    names=["ids", "data", "width"],
                )
                ids, data = ids[rows:], data[rows:]

    return df.mapInArrow(run, "ids binary, data binary, width int")


def stacked(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Two matrices one above the other, the narrower padded with zeros."""
    width = max(above.shape[1], below.shape[1])
    return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (above, below)])


def unpacked(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(data, "<f8").reshape(len(found), width)


def block_bytes(rows: int, width: int, cores: int, most: int = CANDIDATE_BLOCK) -> int:
    """The size of candidate blocks: about one for each core, of 512 rows at least and ``most`` bytes at most."""
    return min(most, 8 * max(1, width) * max(512, rows * 5 // (4 * cores)))


def streamed(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows ``block, is_query, ids, data, width, more``: each candidate block, and after it every query block.

    ``candidates`` is staged and numbered.  A block is a partition: it is read once, and the queries, which
    are few, are copied to each block.
    """
    staged = stage(candidates.withColumn("number", F.monotonically_increasing_id()), "blocks")
    order = Window.orderBy("number")  # one number for each block
    numbers = staged.select("number").withColumn("block", F.row_number().over(order) - 1)
    count = max(1, numbers.count())
    blocks_ = staged.join(F.broadcast(numbers), "number").select("block", F.lit(False).alias("is_query"), "ids", "data", "width", "more")
    copies = queries.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.lit(True).alias("is_query"), "ids", "data", "width", "more")
    return blocks_.unionByName(copies).repartitionById(count, "block").sortWithinPartitions("block", "is_query")


class Columns:
    """A candidate block, dimension by dimension, its rows in the order of ids."""

    def __init__(self, table: np.ndarray, ids: np.ndarray, step: int = DIMENSIONS):
        exact = norms(table) < _EXACT
        self.large, self.large_ids = table[~exact], ids[~exact]
        table, ids = table[exact], ids[exact]
        order = np.argsort(ids, kind="stable")  # of equal scores the first is the smaller id
        self.ids, self.columns, self.step = ids[order], np.ascontiguousarray(table[order].T), step
        self.starts = list(range(0, len(self.columns), step)) or [0]
        squares = self.columns**2
        self.mass = np.stack([squares[s : s + step].sum(0) for s in self.starts]) if len(self.columns) else np.zeros((1, len(ids)))
        self.total = self.mass.sum(0)

    def best(self, q: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for one query, or of fewer where others fall below ``floor``."""
        width = len(self.columns)
        q = np.pad(q, (0, max(0, width - len(q))))[:width]
        mine = np.array([float(q[s : s + self.step] @ q[s : s + self.step]) for s in self.starts])
        order = np.argsort(-mine, kind="stable")
        left_q = np.maximum(mine.sum() - np.cumsum(mine[order]), 0.0)
        alive, score, rest = np.flatnonzero(self.ids != own), None, None
        for part, g in enumerate(order.tolist()):
            if not len(alive):
                break
            dims = slice(self.starts[g], self.starts[g] + self.step)
            if score is None:
                score, rest = (q[dims] @ self.columns[dims])[alive], (self.total - self.mass[g])[alive]
            elif len(alive) == len(self.ids):
                score, rest = score + q[dims] @ self.columns[dims], rest - self.mass[g]
            else:
                score, rest = score + q[dims] @ self.columns[dims][:, alive], rest - self.mass[g][alive]
            if left_q[part] == 0.0 or part + 1 == len(order):
                break
            if part % 3 == 0 and len(alive) > k:  # the k-th best full score of the most promising
                ahead = alive[np.argpartition(-score, min(4 * k, len(alive) - 1))[: 4 * k]]
                full = np.sort(q @ self.columns[:, ahead])[::-1]
                floor = max(floor, full[k - 1])
            # squared masses are integers; the root is raised a little to stay a bound
            stays = score + np.sqrt(left_q[part] * rest) * (1 + 1e-12) + 1e-6 >= floor
            if not stays.all():
                alive, score, rest = alive[stays], score[stays], rest[stays]
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(alive) > k:
            bar = np.partition(score, len(score) - k)[len(score) - k]
            over, level = np.flatnonzero(score > bar), np.flatnonzero(score == bar)
            kept = np.concatenate((over, level[: k - len(over)]))
            alive, score = alive[kept], score[kept]
        return self.ids[alive], score.astype(np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, block: Columns, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query, as far as they can be among the k best of all: query numbers, ids and integer scores."""
    exact = norms(queries) < _EXACT
    small = (block.columns.T, block.ids)
    out_q, out_i, out_s = [], [], []
    for number, (q, own, floor) in enumerate(zip(queries, query_ids.tolist(), floors.tolist(), strict=True)):
        ids, scores = block.best(q, own, floor, k) if exact[number] else _by_integers(q, own, *small, k)
        if len(block.large):
            more, theirs = _by_integers(q, own, block.large, block.large_ids, k)
            ids, scores = np.concatenate((ids, more)), np.concatenate((scores, theirs))
        out_q.append(np.full(len(ids), number))
        out_i.append(ids)
        out_s.append(scores)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_q, out_i, out_s))


def norms(table: np.ndarray) -> np.ndarray:
    """Squared norms of the rows, infinite where they are beyond float64."""
    with np.errstate(over="ignore"):
        return (table * table).sum(1)


def first_floors(queries: np.ndarray, query_ids: np.ndarray, table: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among a sample of the candidates; minus infinity where it is not known."""
    width = min(queries.shape[1], table.shape[1])
    if len(ids) <= k or max(float(norms(m).max(initial=0.0)) for m in (queries, table)) >= _EXACT:
        return np.full(len(queries), -math.inf)
    scores = queries[:, :width] @ table[:, :width].T
    scores[query_ids[:, None] == ids[None, :]] = -math.inf
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


def _by_integers(q: np.ndarray, own: int, table: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of one query by plain integers, for components too large for float64."""
    q = [int(x) for x in q]
    score = lambda row: sum(a * int(b) for a, b in zip(q, row, strict=False))  # noqa: E731  the shorter one goes on with zeros
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best_ = heapq.nsmallest(k, ((-max(least, min(most, score(r))), i) for r, i in zip(table, ids.tolist(), strict=True) if i != own))
    return np.array([i for _, i in best_], np.int64), np.array([-s for s, _ in best_], np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k best candidates.

    Both sides are frames of ``id`` and ``v``; components become ``floor(scale * x)``.
    """
    spark = candidates.sparkSession
    most = F.lit(1e300)
    scaled = F.transform("v", lambda x: _floor(F.greatest(F.least(x * scale, most), -most)))
    rows, asked = (df.select("id", scaled.alias("v")) for df in (candidates, queries))
    size = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    if not size[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # rows of small hash are a sample of at most SEED_ROWS rows
    share = min(1_000_000, 1_000_000 * SEED_ROWS // size[0])
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) <= share).limit(SEED_ROWS).toArrow()
    seed = spark.sparkContext.broadcast((matrix(taken.column("v")), taken.column("id").to_numpy()))
    none = F.lit(b"").alias("more")
    c = blocks(rows, block_bytes(size[0], size[1], spark.sparkContext.defaultParallelism)).select("*", none)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = seed.value
        for batch in batches:
            for row in range(batch.num_rows):
                qi, qv = unpacked(*(batch.column(c)[row].as_py() for c in ("ids", "data", "width")))
                found = first_floors(qv, qi, table, ids, k).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, 1) for c in ("ids", "data", "width")] + [pa.array([found])], names=["ids", "data", "width", "more"])

    q = blocks(asked, QUERY_BLOCK).mapInArrow(floors, "ids binary, data binary, width int, more binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Columns | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                ids, rows = unpacked(of("ids"), of("data"), of("width"))
                if not of("is_query"):
                    block = Columns(rows, ids)
                    continue
                number, found, scores = search(rows, ids, block, np.frombuffer(of("more"), "<f8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[number]), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    found = streamed(q, c).mapInArrow(run, "query_id long, vec_id long, score long")
    return best(found, k)


def _floor(x):
    """Floor as a double, also beyond 64-bit integers."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
