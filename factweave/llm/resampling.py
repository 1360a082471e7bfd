"""Operator 11: resampling towards a target distribution by importance weights of hashed n-grams.

A document's features are its runs of one to ``grams`` words, hashed into buckets.  The target
texts and all documents are counted by bucket; a bucket's gain is 1000 times the logarithm of the
ratio of both smoothed shares, rounded down.  The gains are one array of as many entries as there
are buckets; a document's weight is the sum over its features, read from that array, and its
score the weight plus Gumbel noise from a hash of its id.  Of the documents with enough words
the highest scores are drawn, which is sampling without replacement in proportion to exp(weight / 1000).

The draw.  Each partition sorts its eligible rows into runs, written in blocks to the shared
folder.  Heads of blocks, a bounded sample of them, give keys that cut all runs into ranges; counts by
range say in which one the draw ends, and where ranks begin in each.  Ranges beyond are not read
again.  A range is one task: its pieces of all runs meet in a tournament tree (trees of trees
where there are many runs), which stops after the range's exact share of the draw.

Results: a null text has no feature; texts of any length are taken whole; a document without
features has weight 0; of equal scores the smaller id is first, rows without an id last, of
repeated rows the first in place; an id that is null is hashed as the empty text; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, prepare, scanned, stage, text_of, text_slices

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Rows that a task sorts into one run, rows of a block of it, and leaves of one tree.
RUN_ROWS, BLOCK_ROWS, FAN_IN = 1 << 20, 1024, 64
#: Rows of a range, where that gives no more than so many ranges; heads of blocks sampled for each.
RANGE_ROWS, RANGES, HEADS = 16_384, 4096, 16
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
LAST = (1 << 63) - 1


def _table() -> np.ndarray:
    """The table of CRC-32 for single bytes, from its reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ (np.uint32(0xEDB88320) * (out & 1))
    return out


_CRC = _table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Digits, small letters, and all bytes of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a string column, and its words: where they start and stop in them, and in which row they are."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = _LOWER[np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]]] if whole is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    begins[firsts] = inside[1:-1][firsts]  # a row's first byte goes on with no word of the row before
    ends[firsts[1:] - 1] = inside[1:-1][firsts[1:] - 1]
    starts = np.flatnonzero(begins)
    return data, starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def crc32(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of many pieces of ``data`` at once, going on from the values of ``before``."""
    state = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    length = stops - starts
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        state[i] = zlib.crc32(data[starts[i] : stops[i]].tobytes(), int(state[i]))
    short = np.flatnonzero(length <= LONG_WORD)
    order = short[np.argsort(LONG_WORD - length[short].astype(np.uint8), kind="stable")]  # longest first
    reach = np.searchsorted(-length[order], -np.arange(LONG_WORD), side="left")  # pieces with a byte at each place
    now, at = ~state[order], starts[order]
    for place, n in enumerate(reach.tolist()):
        if not n:
            break
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + place]) & 255] ^ (now[:n] >> 8)
    state[order] = ~now
    return state


def features(column: pa.Array, buckets: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each feature of a string column; and how many words each row has."""
    data, starts, stops, owner = words_of(column)
    state, first = crc32(data, starts, stops), np.arange(len(starts))
    rows, found = [owner], [state % buckets]
    blank = np.array([32], np.uint8)
    for n in range(1, grams):
        first = first[: max(0, len(starts) - n)]
        first = first[owner[first] == owner[first + n]]
        zero = np.zeros(len(first), np.int64)
        state_of = np.zeros(len(starts), np.uint32)
        state_of[first] = crc32(data, starts[first + n], stops[first + n], crc32(blank, zero, zero + 1, state[first]))
        state = state_of
        rows.append(owner[first])
        found.append(state[first] % buckets)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), np.bincount(owner, minlength=len(column))


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """How many features of all texts fall into each bucket: an array of ``buckets`` numbers, whatever the table's size."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                total += np.bincount(features(part.column("text"), buckets, grams)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_of(column).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of each of B buckets."""
    b, all_t, all_s = len(target), float(target.sum()), float(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + b) / ((s + 1.0) * (all_t + b)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """1000 times a Gumbel draw from a hash of the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "_rid long, doc_id long, n_words long, n_features long, weight long, score long"


def scored(documents: DataFrame, gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """Weight and score of every document (:data:`SCORED`), by the array of gains."""
    prepare(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(gain)  # as many numbers as there are buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                row, bucket, words = features(part.column("text"), len(held.value), grams)
                weight = np.bincount(row, weights=held.value[bucket], minlength=part.num_rows).astype(np.int64)  # whole numbers far below 2^53
                drawn = np.array([noise(seed, x) for x in part.column("doc_id").to_pylist()], np.int64)
                numbers = (words, np.bincount(row, minlength=part.num_rows), weight, weight + drawn)
                yield pa.RecordBatch.from_arrays([part.column("_rid"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers)], names=[f.split()[0] for f in SCORED.split(", ")])

    rows = scanned(documents).select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, SCORED)


class Tournament:
    """A loser tree over sorted runs: each row costs one comparison a level, and no more rows are asked for than are taken."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self._runs = [iter(r) for r in runs]
        self._heads = [next(r, None) for r in self._runs]
        self._losers = [0] * max(1, len(runs))
        self._winner = self._built(1) if runs else 0

    def _first(self, a: int, b: int) -> tuple[int, int]:
        """Both leaves, the one that goes first in front; of equal heads the earlier run."""
        x, y = self._heads[a], self._heads[b]
        return (a, b) if y is None or x is not None and (x, a) <= (y, b) else (b, a)

    def _built(self, node: int) -> int:
        n = len(self._runs)
        if node >= n:
            return node - n
        winner, self._losers[node] = self._first(self._built(2 * node), self._built(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple]:
        if not self._runs:
            return
        n = len(self._runs)
        while (head := self._heads[self._winner]) is not None:
            yield head
            leaf = self._winner
            self._heads[leaf] = next(self._runs[leaf], None)
            node = (leaf + n) // 2
            while node:
                leaf, self._losers[node] = self._first(leaf, self._losers[node])
                node //= 2
            self._winner = leaf


def merged(runs: list[Iterable[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """The rows of all runs in order, through trees of at most ``fan_in`` leaves each."""
    while len(runs) > fan_in:
        runs = [Tournament(runs[i : i + fan_in]) for i in range(0, len(runs), fan_in)]
    return iter(Tournament(runs))


RUNS = "run long, seq int, score long, doc long, rid long, n int, keys binary"


def sorted_runs(eligible: DataFrame, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each partition's rows (``score, doc_id, _rid``) as sorted runs in blocks; a row is ``-score, id, rid``, and a block has its first row beside."""

    def blocks(run: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(parts)
        keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
        starts = range(0, len(keys), block_rows)
        heads = keys[::block_rows]
        made = [keys[s : s + block_rows] for s in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * len(made), pa.int64()), pa.array(range(len(made)), pa.int32())]
            + [pa.array(heads[:, i], pa.int64()) for i in range(3)]
            + [pa.array([len(m) for m in made], pa.int32()), pa.array([m.astype("<i8").tobytes() for m in made], pa.binary())],
            names=[f.split()[0] for f in RUNS.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").fill_null(LAST).to_numpy()
            held.append(np.stack([-batch.column("score").to_numpy(), doc, batch.column("_rid").to_numpy()], 1))
            rows += batch.num_rows
            if rows >= run_rows:
                yield from blocks(number, held)
                number, held, rows = number + 1, [], 0
        if held:
            yield from blocks(number, held)

    return eligible.select("score", "doc_id", "_rid").mapInArrow(run, RUNS)


@dataclass
class Ranges:
    """Keys that cut all runs into ranges, the first rank in each, and how many rows each one gives."""

    cuts: list[tuple]
    first: list[int]
    take: list[int]

    def pieces(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Range, start and stop of each piece of a sorted block."""
        at, n = 0, len(keys)
        while at < n:
            r = bisect_right(self.cuts, tuple(keys[at].tolist()))
            low, high = at + 1, n
            if r < len(self.cuts):
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if tuple(keys[mid].tolist()) >= self.cuts[r] else (mid + 1, high)
            else:
                low = n
            yield r, at, low
            at = low


def cuts_of(runs: DataFrame, rows: int, range_rows: int, most: int, heads: int = HEADS) -> list[tuple]:
    """Keys of ranges of about ``range_rows`` rows, ``most`` at most, from a bounded sample of the heads of blocks."""
    wanted = min(most, rows // range_rows + 1)
    total = runs.count()
    million = 1_000_000
    share = min(million, math.ceil(million * heads * wanted / max(1, total)))
    chosen = runs.filter(F.pmod(F.xxhash64("run", "seq"), F.lit(million)) < share).select("score", "doc", "rid").limit(4 * heads * wanted)
    found = sorted(map(tuple, chosen.collect()))
    return sorted({found[len(found) * i // wanted] for i in range(1, wanted)}) if found else []


def ranked(eligible: DataFrame, draw: int, rows: int, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``_rid`` and ``rank`` (from 1) of the first ``draw`` of ``rows`` rows ``score, doc_id, _rid``."""
    runs = stage(sorted_runs(eligible, run_rows, block_rows), "runs")
    plan = Ranges(cuts_of(runs, rows, range_rows, RANGES), [], [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, seq, data in zip(*(batch.column(c).to_pylist() for c in ("run", "seq", "keys")), strict=True):
                keys = np.frombuffer(data, "<i8").reshape(-1, 3)
                out += [(r, run, seq, b - a, keys[a:b].tobytes()) for r, a, b in plan.pieces(keys)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["range", "run", "seq", "n", "keys"])

    pieces = runs.select("run", "seq", "keys").mapInArrow(cut, "range int, run long, seq int, n long, keys binary")
    counts = {r["range"]: r["n"] for r in pieces.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # at most RANGES
    before = 0
    for r in range(len(plan.cuts) + 1):
        plan.first.append(before + 1)
        plan.take.append(min(counts.get(r, 0), draw - before))
        before += plan.take[-1]
        if before == draw:
            break
    first, take = plan.first, plan.take

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(r: int, found: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            in_order = merged([zip(*np.concatenate(p).T.tolist(), strict=True) for p in found.values()], fan_in)
            rids = [key[2] for key, _ in zip(in_order, range(take[r]), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(range(first[r], first[r] + len(rids)), pa.int64())], names=["_rid", "rank"])

        now, found = None, {}
        for batch in batches:
            for r, run, data in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "keys")), strict=True):
                if r != now and found:
                    yield from ended(now, found)
                    found = {}
                now = r
                found.setdefault(run, []).append(np.frombuffer(data, "<i8").reshape(-1, 3))
        if found:
            yield from ended(now, found)

    needed = pieces.filter(F.col("range") < len(take)).repartitionById(len(take), "range").sortWithinPartitions("range", "run", "seq")
    return needed.mapInArrow(merge, "_rid long, rank long")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED, **sizes: int) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null for those that are not drawn."""
    gain = gains(bucket_counts(target, "text", buckets, grams), bucket_counts(documents, "text", buckets, grams))
    rows = stage(scored(documents, gain, grams, seed), "scores")
    eligible = rows.filter(F.col("n_words") >= least_words)
    n = eligible.count()
    draw = percent * n // 100
    out = attached(rows, ranked(eligible, draw, n, **sizes), "ranks") if draw else rows.withColumn("rank", F.lit(None).cast("long"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
    WITH tab AS (
        SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t
    ), d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), b AS (
        SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), dw AS MATERIALIZED (
        SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word
    ), bw AS MATERIALIZED (
        SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word
    ), distinct_words AS MATERIALIZED (
        SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)
    ), hashed AS MATERIALIZED (
        SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(CAST(len(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
        FROM distinct_words CROSS JOIN tab
    ), s AS (
        SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket
    ), t AS (
        SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket
    ), g AS (
        SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) AS DOUBLE) * CAST((coalesce((SELECT sum(n) FROM s), 0) + 10000) AS DOUBLE) / (CAST(s.n + 1 AS DOUBLE) * CAST((coalesce((SELECT sum(n) FROM t), 0) + 10000) AS DOUBLE)))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket)
    ), weight AS (
        SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY r
    ), scored AS (
        SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
        FROM d LEFT JOIN weight USING (r)
    ), drawn AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (r)
"""
