"""Operator 9: approximate nearest neighbours by inner product, an inverted file with product quantisation.

Coarse centroids and the codebooks of residuals are fitted by k-means on a bounded sample; every
row is indexed, under its two nearest lists.  How many lists a query visits is found by
measurement: queries that are held back from the fit look for the k best rows of the sample, and
the least number of lists is taken that holds RECALL of them.  The rule is the same at any size.

The index is cut into blocks of rows, each with inverted lists of its own (places ordered by
list, the lists' bounds, one byte per subspace), so that a list of any size is spread over as many
tasks as it has blocks.  A block goes to its task once, and the queries are streamed past it.  A
query visits its lists, ranks their rows by asymmetric distance tables, and the best of each block are scored
again on the original vectors in double precision, ``rerank * k`` or more over all blocks.

Results: vectors that are null, all zero, or hold null or non-finite components take no
part; neither do rows without an id.  Shorter vectors count as padded with zeros, long ones take
more memory by their length only.  A query's own id is no candidate.  Repeated rows are candidates
each, equal vectors share lists and codes, and ties go to the smaller id.  An empty table gives an
empty one.  Other columns, whatever their names, are not read.  A block that has fewer than k rows
in the visited lists goes on to further lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import QUERY_BLOCK, best, block_bytes, blocks, matrix, streamed, unpacked, vectors

#: The fit takes about so many rows, by a hash of their ids, and at most twice as many; queries that are held back from it.
SAMPLE_ROWS, HELD_BACK = 32_768, 256
#: Share of the held-back queries' neighbours that the visited lists must hold; candidates that are scored exactly, as a multiple of k.
RECALL, RERANK = 0.94, 20
#: Lists for each square root of the rows, as far as the sample has SAMPLE_PER_LIST rows for each; lists that a row stands in.
LISTS, SAMPLE_PER_LIST, ASSIGNED = 4, 8, 2
SUBSPACES, CODES, ROUNDS = 8, 256, 8


@dataclass
class Quantiser:
    """Coarse centroids and, for each subspace, its dimensions and codebook."""

    centroids: np.ndarray
    spans: list[tuple[int, int]]
    books: list[np.ndarray]
    probes: int = 1

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def fitted(self, x: np.ndarray) -> np.ndarray:
        """``x`` with as many columns as the centroids; what lies beyond adds nothing to the choice of lists."""
        return np.pad(x, ((0, 0), (0, max(0, self.width - x.shape[1]))))[:, : self.width]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, lists and codes of all places: each row has one in each of its lists."""
        lists = nearest(x, self.centroids, min(ASSIGNED, len(self.centroids)))
        rows, lists = np.repeat(np.arange(len(x)), lists.shape[1]), lists.ravel()
        rest = x[rows] - self.centroids[lists]
        codes = np.stack([nearest(rest[:, a:b], book)[:, 0] for (a, b), book in zip(self.spans, self.books, strict=True)], 1)
        return rows, lists, codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with every code, subspace after subspace."""
        out = np.zeros((len(q), len(self.books), CODES))
        for i, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            out[:, i, : len(book)] = q[:, a:b] @ book.T
        return out.reshape(len(q), -1)


def nearest(x: np.ndarray, centres: np.ndarray, many: int = 1, rows: int = 2048) -> np.ndarray:
    """The ``many`` nearest centres of each row by Euclidean distance, the nearest first."""
    half = (centres * centres).sum(1) / 2
    parts = [np.empty((0, many), np.int64)]
    for i in range(0, len(x), rows):
        score = x[i : i + rows] @ centres.T - half
        if many == 1:
            parts.append(score.argmax(1)[:, None])
        else:
            found = np.argpartition(-score, many - 1, axis=1)[:, :many]
            parts.append(np.take_along_axis(found, np.argsort(-np.take_along_axis(score, found, 1), axis=1, kind="stable"), 1))
    return np.concatenate(parts)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres; a centre that loses all its rows restarts at a random one."""
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    centres = different[rng.choice(len(different), k, replace=False)]
    for _ in range(ROUNDS):
        owner = nearest(x, centres)[:, 0]
        counts = np.bincount(owner, minlength=k)
        sums = np.stack([np.bincount(owner, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = different[rng.choice(len(different), len(empty))]
    return centres


def fit(sample: np.ndarray, rows: int, k: int, recall: float = RECALL, seed: int = 7) -> Quantiser:
    """A quantiser for ``rows`` rows.

    The number of lists grows with their square root, as far as the sample can place their centres.
    """
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(sample))
    held = sample[mixed[: min(HELD_BACK, len(sample) // 5)]]
    learnt = sample[mixed[len(held) :]] if len(held) else sample
    lists = max(1, min(LISTS * math.isqrt(rows), len(learnt) // SAMPLE_PER_LIST))
    centroids = k_means(learnt, lists, rng)
    rest = learnt - centroids[nearest(learnt, centroids)[:, 0]]
    cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, max(1, sample.shape[1])) + 1).astype(int).tolist()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    model = Quantiser(centroids, spans, [k_means(rest[:, a:b], CODES, rng) for a, b in spans])
    model.probes = probes_for(model, learnt, held, k, recall)
    return model


def probes_for(model: Quantiser, rows: np.ndarray, held: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that hold ``recall`` of the held-back queries' k best rows; all lists without such queries."""
    total = len(model.centroids)
    if not len(held) or len(rows) <= k:
        return total
    lists = nearest(rows, model.centroids, min(ASSIGNED, total))
    deepest = []
    for q in held:
        turn = np.empty(total, np.int64)
        turn[np.argsort(-(model.centroids @ q), kind="stable")] = np.arange(total)
        top = np.argpartition(-(rows @ q), k)[:k]
        deepest.append(turn[lists[top]].min(1))
    return int(np.sort(np.concatenate(deepest))[max(0, math.ceil(recall * k * len(held)) - 1)]) + 1


def index_block(model: Quantiser, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all places in the order of their lists and ids, the lists' bounds, and the codes."""
    rows, lists, codes = model.assign(model.fitted(x))
    order = np.lexsort((ids[rows], lists))
    bounds = np.searchsorted(lists[order], np.arange(len(model.centroids) + 1))
    return rows[order], bounds, codes[order]


def first_by(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) <= k:
        return np.arange(len(score))
    bar = np.partition(score, len(score) - k)[len(score) - k]
    over, level = np.flatnonzero(score > bar), np.flatnonzero(score == bar)
    need = k - len(over)
    if need < len(level):
        level = level[np.argpartition(ids[level], need)[:need]]
    return np.concatenate((over, level))


@dataclass
class Block:
    """Vectors with inverted lists of their own."""

    ids: np.ndarray
    x: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray

    @classmethod
    def read(cls, ids: np.ndarray, x: np.ndarray, data: bytes, lists: int) -> Block:
        """From the bytes that :meth:`written` made."""
        head = np.frombuffer(data, "<i4", lists + 2)
        places, at = int(head[0]), 4 * (lists + 2)
        rows = np.frombuffer(data, "<i4", places, at)
        return cls(ids, x, rows, head[1:], np.frombuffer(data, np.uint8, offset=at + 4 * places).reshape(places, -1))

    @staticmethod
    def written(rows: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> bytes:
        return np.concatenate(([len(rows)], bounds, rows)).astype("<i4").tobytes() + codes.tobytes()

    def search(self, model: Quantiser, qi: np.ndarray, qv: np.ndarray, k: int, rerank: int) -> tuple[list[np.ndarray], int]:
        """Query ids, ids and scores of the k best found for each query; and how many places were looked at."""
        width = max(qv.shape[1], self.x.shape[1])
        exact_q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (qv, self.x))
        near = model.fitted(qv)
        coarse = near @ model.centroids.T
        tables = model.tables(near)
        sizes = np.diff(self.bounds)
        flat = self.codes.astype(np.intp) + np.arange(self.codes.shape[1]) * CODES
        least = ASSIGNED * (k + 1)  # places that hold k rows besides the query itself, at least
        out, looked = [], 0
        for n, own in enumerate(qi.tolist()):
            lists = np.argpartition(-coarse[n], model.probes - 1)[: model.probes]
            if sizes[lists].sum() < least:
                order = np.argsort(-coarse[n], kind="stable")
                lists = order[: max(model.probes, int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1)]
            many = sizes[lists]
            total = int(many.sum())
            if not total:
                continue
            places = np.repeat(self.bounds[lists] - (np.cumsum(many) - many), many) + np.arange(total)
            score = np.repeat(coarse[n][lists], many) + tables[n].take(flat[places]).sum(1)
            looked += total
            # a row stands in ASSIGNED lists at most, so the best places hold ``rerank`` rows besides the query
            best_ = first_by(score, self.rows[places], ASSIGNED * (rerank + 1))
            rows = np.unique(self.rows[places[best_]])
            rows = rows[self.ids[rows] != own]
            exact = (x[rows] * exact_q[n]).sum(1)
            top = first_by(exact, self.ids[rows], k)
            out.append((np.full(len(top), own), self.ids[rows][top], exact[top]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], looked


def fitted(rows: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> Quantiser | None:
    """A quantiser for all of ``rows`` (``id, v``), from a bounded sample of them; nothing for an empty table."""
    total = rows.count()
    if not total:
        return None
    million = 1_000_000
    share = min(million, math.ceil(million * sample_rows / total))
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(million)) < share).limit(2 * sample_rows).select("v").toArrow()
    sample = matrix(taken.column("v"))
    if not len(sample):  # so few rows that the hash took none
        sample = matrix(rows.limit(sample_rows).select("v").toArrow().column("v"))
    return fit(sample, total, k, recall)


def neighbours(embeddings: DataFrame, queries: DataFrame, k: int, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k nearest found.

    Both frames are ``id, v`` as ``topk.vectors`` gives them; all of ``embeddings`` is indexed.
    """
    spark = embeddings.sparkSession
    not_zero = F.exists("v", lambda x: x != 0)
    rows, chosen = embeddings.filter(not_zero), queries.filter(not_zero)
    model = fitted(rows, k, sample_rows, recall)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(model)  # bounded by the sample
    size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block_bytes(size[0], size[1], spark.sparkContext.defaultParallelism)
    # what a block scores exactly is its share of rerank * k, taken twice, as shares vary, and 2 * k at least
    share = max(2 * k, 2 * rerank * k * block // (8 * max(1, size[1]) * size[0]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x = unpacked(*(batch.column(c)[row].as_py() for c in ("ids", "data", "width")))
                made = Block.written(*index_block(held.value, ids, x))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, 1) for c in ("ids", "data", "width")] + [pa.array([made])], names=["ids", "data", "width", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block = held.value, None
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                ids, x = unpacked(of("ids"), of("data"), of("width"))
                if not of("is_query"):
                    block = Block.read(ids, x, of("more"), len(model.centroids))
                    continue
                found, _ = block.search(model, ids, x, k, min(share, rerank * k))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    index = blocks(rows, block).mapInArrow(build, "ids binary, data binary, width int, more binary")
    found = streamed(blocks(chosen, QUERY_BLOCK).withColumn("more", F.lit(b"")), index).mapInArrow(run, "query_id long, vec_id long, score double")
    return best(found, k)


__all__ = ["fitted", "neighbours", "vectors"]
