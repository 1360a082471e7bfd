"""Operator 13: k-means on integer vectors with Hamerly's bounds.

Components become integers, ``floor(scale * x)``, and centroids stay integers: the mean's
components, rounded down.  Vectors lie in blocks; beside a block's vectors its row holds for each
of them the centroid, an upper bound of the distance to that one and a lower bound of the distance to
the second nearest.  When centroids have moved, the upper bound grows by the drift of its centroid and the lower
one falls by the largest drift of the others.  While the upper bound stays under the lower one, or
under half the way to the centroid's nearest neighbour, the vector keeps its centroid and nothing is computed.
Otherwise the upper bound is tightened by the exact distance; what is still ambiguous is scanned
against all centroids in exact integers, ties to the smaller number.

Bounds are rounded outwards, so what is skipped has one nearest centroid for certain, and the
result is that of full scans.  A round is one pass over the blocks without a shuffle: blocks with their new
bounds are written to the shared folder (a lost executor repeats only its own), sums by centroid are
added up by Spark, and only the centroids, ``k`` rows, go to the driver and back to the tasks.

Results: vectors that are null, of another number of components, or that hold null or non-finite
components take no part; components beyond what squared distances of 64 bits can hold (2^27 for 64 of
them) count as that bound, sums of distances beyond 64 bits as the greatest number of 64 bits;
of fewer vectors than centroids each one is a centroid; rows with equal ids are vectors each, in the first choice ordered
by their components; rows without an id take part and are chosen last; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import done_with
from .common import prepare, scanned, stage
from .topk import matrix

CLUSTERS, ROUNDS, DIMENSIONS, SEED, SCALE = 40, 5, 64, 2, 256.0
#: Bytes of the vectors of a block; rows whose distances to all centroids are held at once.
BLOCK_BYTES, SCAN_ROWS = 2 << 20, 4096
_OUT, _IN = 1 + 1e-12, 1 - 1e-12
LARGEST = (1 << 63) - 1


def limit(dimensions: int) -> int:
    """The bound of components: squared distances of vectors within it fit 63 bits."""
    return 1 << (61 - max(1, dimensions - 1).bit_length()) // 2


def kept(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """``id`` and ``v`` (integers) of the vectors that take part."""
    most = float(limit(dimensions))
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))).cast("int"))
    return scanned(df).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False))).select("id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the least hashes, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact: by float64 while every part stays below 2^53, else by 64-bit integers."""
    largest = max(float(np.abs(m).max(initial=0)) for m in (x, c))
    if 4 * x.shape[1] * largest**2 < float(1 << 53):
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    a = x.astype(np.int64)
    return np.stack([((a - one) ** 2).sum(1) for one in c.astype(np.int64)], 1)


def own_distances(x: np.ndarray, c: np.ndarray, assigned: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to their own centroids, exact."""
    gap = x.astype(np.int64) - c[assigned]
    return (gap * gap).sum(1)


@dataclass
class Round:
    """Centroids, how far each has moved since the round before, and what follows from both."""

    centroids: np.ndarray
    drift: np.ndarray

    def __post_init__(self):
        apart = np.sqrt(distances(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1, initial=np.inf) / 2 * _IN
        order = np.argsort(-self.drift, kind="stable")
        second = self.drift[order[1]] if len(order) > 1 else 0.0
        self.others = np.where(np.arange(len(order)) == order[0], second, self.drift[order[0]])  # the largest drift of all others

    def assign(self, x: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New centroids and bounds of a block's rows, and how many rows were scanned; ``assigned`` is -1 before the first round."""
        assigned, known = assigned.copy(), assigned >= 0
        upper = np.where(known, (upper + self.drift[assigned]) * _OUT, np.inf)
        lower = np.where(known, lower * _IN - self.others[assigned] * _OUT, -np.inf)
        apart = np.where(known, np.maximum(lower, self.half[assigned]), -np.inf)
        loose = np.flatnonzero(known & (upper >= apart))
        upper[loose] = np.sqrt(own_distances(x[loose], self.centroids, assigned[loose])) * _OUT
        ambiguous = np.flatnonzero(~(upper < apart))
        for at in range(0, len(ambiguous), SCAN_ROWS):
            rows = ambiguous[at : at + SCAN_ROWS]
            d = distances(x[rows], self.centroids)
            assigned[rows] = d.argmin(1)  # the first of equal ones
            upper[rows] = np.sqrt(d.min(1)) * _OUT
            lower[rows] = np.sqrt(np.partition(d, 1, axis=1)[:, 1]) * _IN if d.shape[1] > 1 else np.inf
        return assigned, upper, lower, len(ambiguous)

    def sums(self, x: np.ndarray, assigned: np.ndarray) -> np.ndarray:
        """Count and sum of the rows of each centroid, ``k`` rows of one number more than components."""
        out = np.zeros((len(self.centroids), x.shape[1] + 1), np.int64)
        order = np.argsort(assigned, kind="stable")
        numbers, starts, counts = np.unique(assigned[order], return_index=True, return_counts=True)
        out[numbers, 0] = counts
        if len(order):
            out[numbers, 1:] = np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
        return out

    def moved(self, sums: np.ndarray) -> Round:
        """The next round: means rounded down; a centroid without vectors stays."""
        count = sums[:, :1]
        centroids = np.where(count > 0, sums[:, 1:] // np.maximum(count, 1), self.centroids)
        return Round(centroids, np.sqrt(own_distances(self.centroids, centroids, np.arange(len(centroids))).astype(np.float64)) * _OUT)


BLOCKS = "ids array<long>, data binary, assigned binary, upper binary, lower binary"
STEP = BLOCKS + ", sums array<long>, scanned long"
LAST = "ids array<long>, assigned binary, distance binary, inertia array<decimal(38,0)>"


def blocks(vectors: DataFrame, dimensions: int, size: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``id, v`` in blocks (:data:`BLOCKS`), not yet assigned."""
    rows = max(1, size // (4 * dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], np.empty((0, dimensions), np.int32)
        for batch in chain(batches, (None,)):
            if batch is not None and batch.num_rows:
                ids += batch.column("id").to_pylist()
                data = np.concatenate((data, matrix(batch.column("v")).astype(np.int32)))
            while len(ids) >= rows or batch is None and ids:
                n = min(rows, len(ids))
                state = (data[:n].astype("<i4"), np.full(n, -1, "<i4"), np.full(n, np.inf), np.full(n, -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([ids[:n]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in state)], names=["ids", "data", "assigned", "upper", "lower"])
                ids, data = ids[n:], data[n:]

    return vectors.mapInArrow(run, BLOCKS)


def _blocks_of(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block as a batch of its own, its vectors, and their state."""
    for batch in batches:
        for row in range(batch.num_rows):
            of = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
            yield batch.slice(row, 1), of("data", "<i4").reshape(-1, dimensions), of("assigned", "<i4"), of("upper", "<f8"), of("lower", "<f8")


def step(state: DataFrame, now: Round) -> DataFrame:
    """One round over all blocks (:data:`STEP`)."""
    held, dimensions = state.sparkSession.sparkContext.broadcast(now), now.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, *before in _blocks_of(batches, dimensions):
            assigned, upper, lower, scanned_ = held.value.assign(x, *before)
            sums = held.value.sums(x, assigned).ravel()
            made = [pa.array([a.tobytes()], pa.binary()) for a in (assigned.astype("<i4"), upper.astype("<f8"), lower.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("data"), *made, pa.array([sums], pa.list_(pa.int64())), pa.array([scanned_], pa.int64())], names=[f.split()[0] for f in STEP.split(", ")])

    return state.select("ids", "data", "assigned", "upper", "lower").mapInArrow(run, STEP)


def added(frame: DataFrame, column: str, length: int) -> list:
    """The arrays of ``column`` added up place by place, whatever the number of blocks."""
    out = [0] * length
    for r in frame.select(F.posexplode(column).alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect():
        out[r["place"]] = int(r["x"])
    return out


def last_step(state: DataFrame, now: Round) -> DataFrame:
    """The assignment to the final centroids, with exact distances (:data:`LAST`)."""
    held, (k, dimensions) = state.sparkSession.sparkContext.broadcast(now), now.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, *before in _blocks_of(batches, dimensions):
            assigned = held.value.assign(x, *before)[0]
            distance = own_distances(x, held.value.centroids, assigned)
            inertia = [0] * k
            for number in np.unique(assigned).tolist():
                inertia[number] = sum(distance[assigned == number].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), pa.array([assigned.astype("<i4").tobytes()], pa.binary()), pa.array([distance.astype("<i8").tobytes()], pa.binary()), pa.array([inertia], pa.list_(pa.decimal128(38, 0)))],
                names=["ids", "assigned", "distance", "inertia"],
            )

    return state.select("ids", "data", "assigned", "upper", "lower").mapInArrow(run, LAST)


@dataclass
class Clustering:
    """The rows of :func:`clustered`, the final centroids, and how many vectors each round scanned in full."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]
    vectors: int


COLUMNS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> Clustering:
    """k-means of ``id, v`` (integers, all of one length)."""
    spark = vectors.sparkSession
    prepare(spark)
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return Clustering(spark.createDataFrame([], COLUMNS), start, [], 0)
    k, dimensions = start.shape
    now, scans, n = Round(start, np.zeros(k)), [], 0
    state = stage(blocks(vectors, dimensions, block_bytes), "vectors")
    for _ in range(rounds):
        before, state = state, stage(step(state, now), "bounds")
        done_with(before)
        scans.append(state.agg(F.sum("scanned")).first()[0])
        sums = np.array(added(state, "sums", k * (dimensions + 1)), np.int64).reshape(k, -1)
        now, n = now.moved(sums), int(sums[:, 0].sum())
    found = stage(last_step(state, now), "clusters")
    done_with(state)
    inertia = added(found, "inertia", k)
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    table = [(i, min(inertia[i], LARGEST), min(sum(inertia), LARGEST), name(c)) for i, c in enumerate(now.centroids.tolist())]
    of_centroid = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                assigned, distance = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("assigned", "<i4"), ("distance", "<i8")))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(assigned, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = found.select("ids", "assigned", "distance").mapInArrow(rows, "vec_id long, cluster int, distance long")
    return Clustering(out.join(F.broadcast(of_centroid), "cluster").select(*(f.split()[0] for f in COLUMNS.split(", "))), now.centroids, scans, n)


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The rounds one after the other, each with full scans."""
    parts = [
        """v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT n, e FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) - 1 AS n, e FROM v) WHERE n < {k}
        )""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
            SELECT r, min(struct_pack(d := d, n := n)) AS best FROM (
                SELECT v.r, c.n, CAST(list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e) AS BIGINT) AS d FROM v CROSS JOIN c{i} c
            ) GROUP BY r
        )""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT c.n, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
                    SELECT n, list(x ORDER BY p) AS e FROM (
                        SELECT n, p, floor(sum(x) / count(*)) AS x FROM (SELECT a.best.n AS n, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS p FROM a{i} a JOIN v USING (r)) GROUP BY n, p
                    ) GROUP BY n
                ) m ON m.n = c.n
            )""")
    return f"""
        WITH {", ".join(parts)}
        SELECT v.vec_id, CAST(a.best.n AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.n = a.best.n
    """


SQL = _sql()
