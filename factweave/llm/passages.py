"""Operator 6: substring deduplication by hashing normalised lines, paragraphs and windows of words.

Units are normalised (ASCII letters lowered, white space collapsed), their digests grouped
globally, the earliest ranked occurrence of each stays, and the others are removed, with their
places in the original text.  There are three kinds of units:

* lines of LINE_WORDS words or more,
* paragraphs (what stands between empty lines) of LINE_WORDS words or more,
* windows of exactly RUN_WORDS words, for passages that begin and end inside lines.  A window
  begins at the word of least hash in some WINDOW words in a row, so its place depends on
  the words around it alone: a passage of L words has a window of its own, the same
  wherever the passage stands, within its first WINDOW + 1 words, and further ones at most
  WINDOW words apart while they fit.  WINDOW + 1 + RUN_WORDS is below 51, so every passage of 51 words is met.

A unit is removed as a whole, so whatever goes has an earlier equal in one place; where removed
units overlap or touch they are one span.  Units in which most words repeat one of the four before
them in the unit are no passages and stay: a word said a hundred times is for another operator to judge.

Results: a null or empty text has no units, an empty table gives an empty one; repeated rows lose
their text but for the first, rows of equal id in their order; rows without an id rank last; other
columns stay, whatever their names; a word is what stands between white space of ASCII.  Texts are
taken whole: they are read in pieces of CHUNK bytes, cut at white space, and of each word some 40 bytes
are held until its text ends, so a very long text needs memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, boxed, spread_join, stage, text_of, text_slices, unboxed

#: Words of a window, and least words of a line or paragraph that is a unit.
RUN_WORDS, LINE_WORDS = 32, 16
#: Of so many words in a row one begins a window; the least of w are one in (w + 1) / 2.
WINDOW = 15
#: Words that repeat one of so many before them do not count.
PERIOD = 4
CHUNK = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _UNIT_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Kinds of units; equal words make different digests in each.
_LINE, _PARAGRAPH, _WINDOW = range(3)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of ``values[start:stop]`` for each range, wherever it stands."""
    size = 1 << max(16, int(len(values)).bit_length())
    up, down = _powers(base, size)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return (upto[stops] - upto[starts]) * down[starts]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of UTF-8 ``data``, and the line breaks before it, at most 2 (which the first has)."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, stops, np.empty(0, np.int8)
    lowered = np.frombuffer(data.translate(_LOWER), np.uint8).astype(np.uint64) + np.uint64(1)
    words = _mix(_sums(lowered, starts, stops, _BASE) + (stops - starts).astype(np.uint64))
    newlines = np.concatenate(([0], np.cumsum(raw == 10)))
    return words, starts, stops, np.concatenate(([2], np.minimum(newlines[starts[1:]] - newlines[stops[:-1]], 2))).astype(np.int8)


def _least(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the least of each WINDOW values in a row of one owner, the last of equal ones."""
    n = len(values) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = values[:n].copy(), np.arange(n)
    for k in range(1, WINDOW):
        lower = values[k : k + n] <= least
        np.copyto(least, values[k : k + n], where=lower)
        np.copyto(place, np.arange(k, k + n), where=lower)
    return place[owner[:n] == owner[WINDOW - 1 :]]


def _repeats(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words of each range equal one of the PERIOD words before them in the range; what stands before the range makes no difference."""
    again, out = np.zeros(len(words), bool), np.zeros(len(first), np.int64)
    for k in range(1, min(PERIOD, len(words) - 1) + 1):
        out += again[np.minimum(first + k - 1, len(words) - 1)] & (first + k - 1 < end)  # a range's k-th word has k - 1 words before it
        again[k:] |= words[k:] == words[:-k]
    upto = np.concatenate(([0], np.cumsum(again)))
    return out + upto[end] - upto[np.minimum(first + PERIOD, end)]


def _units(words: np.ndarray, breaks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first word and end of each unit, in the order of their first words."""
    n = len(words)
    if not n:
        return (np.empty(0, np.int64),) * 3
    new = np.concatenate(([True], owner[1:] != owner[:-1]))
    firsts, ends, kinds = [], [], []
    for kind, least in ((_LINE, 1), (_PARAGRAPH, 2)):
        first = np.flatnonzero((breaks >= least) | new)
        end = np.append(first[1:], n)
        if kind == _PARAGRAPH:  # of one line
            line = np.flatnonzero((breaks >= 1) | new)
            several = np.searchsorted(line, end) - np.searchsorted(line, first) > 1
            first, end = first[several], end[several]
        long = end - first >= LINE_WORDS
        firsts.append(first[long])
        ends.append(end[long])
        kinds.append(np.full(int(long.sum()), kind, np.uint64))
    before = np.concatenate((np.zeros(1, np.uint64), np.where(new[1:], np.uint64(0), words[:-1])))
    first = np.unique(_least(_mix(words + before * np.uint64(_BASE)), owner))
    first = first[first + RUN_WORDS <= n]
    first = first[owner[first] == owner[first + RUN_WORDS - 1]]
    firsts.append(first)
    ends.append(first + RUN_WORDS)
    kinds.append(np.full(len(first), _WINDOW, np.uint64))
    first, end, kind = (np.concatenate(x) for x in (firsts, ends, kinds))
    varied = 2 * _repeats(words, first, end) <= end - first
    first, end, kind = first[varied], end[varied], kind[varied]
    order = np.lexsort((kind, first))
    first, end, kind = first[order], end[order], kind[order]
    digests = _mix(_sums(words, first, end, _UNIT_BASE) + (end - first).astype(np.uint64) * np.uint64(4) + kind)
    return digests.view(np.int64), first, end


def units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first byte, end and number of words of each unit of the one text ``data`` (UTF-8)."""
    words, starts, stops, breaks = _words(data)
    digests, first, end = _units(words, breaks, np.zeros(len(words), np.int64))
    return digests, starts[first], stops[end - 1], end - first


def chunks(data: bytes, limit: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """``data`` in pieces with their places, cut after a newline, or else after a blank, where there is one."""
    at = 0
    while at < len(data):
        to = min(len(data), at + limit)
        if to < len(data):
            to = max(data.rfind(b"\n", at, to), data.rfind(b" ", to - limit // 8, to)) + 1 or to
            to = to if to > at else min(len(data), at + limit)
        yield at, data[at:to]
        at = to


#: Of each unit its digest, its character range and its words (first and number); ``own`` are units that the document had before.
_TABLE = "digests array<long>, starts array<int>, stops array<int>, firsts array<int>, sizes array<int>, own array<boolean>"


def cut(documents: DataFrame) -> DataFrame:
    """``_rid``, ``rank`` and the units of each document."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = documents.select("_rid", rank.alias("rank"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield from _cut_batch(part)

    return rows.mapInArrow(run, f"_rid long, rank long, {_TABLE}")


def _cut_batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
    found: list[list[np.ndarray]] = []  # owner, digest, start, stop, first word, words
    held: list[list[np.ndarray]] = []  # word, start, stop, line breaks before it, owner
    group: list[tuple[int, int, bytes, int]] = []  # owner, characters before, piece, line breaks at the end of what was before
    pending = 0

    def read() -> None:
        """The words of the pieces."""
        nonlocal pending
        if not group:
            return
        joined = b"\n".join(d for _, _, d, _ in group) + b"\n"
        sizes = np.array([len(d) + 1 for _, _, d, _ in group])
        places = np.cumsum(sizes) - sizes
        word, start, stop, breaks = _words(joined)
        piece = np.searchsorted(places, start, side="right") - 1
        for first, place, (_, _, d, fresh) in zip(np.searchsorted(start, places).tolist(), places.tolist(), group, strict=True):
            if first < len(start) and start[first] < place + len(d):
                breaks[first] = min(2, fresh + d[: start[first] - place].count(b"\n"))
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)))
        shift = np.array([s for _, s, _, _ in group]) - chars[places]
        held.append([word, chars[start] + shift[piece], chars[stop] + shift[piece], breaks, np.array([o for o, *_ in group])[piece]])
        group.clear()
        pending = 0

    def flush() -> None:
        """The units of whole texts, so that the ends of pieces make no difference."""
        read()
        if not held:
            return
        word, start, stop, breaks, owner = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        digest, first, end = _units(word, breaks, owner)
        begin = np.searchsorted(owner, owner[first])  # of the document
        found.append([owner[first], digest, start[first], stop[end - 1], first - begin, end - first])

    for owner, data in enumerate(texts):
        if pending + len(data) > CHUNK:
            flush()
        seen, breaks = 0, 2  # characters of this text before the piece, and line breaks at their end
        for _, piece in chunks(data):
            if pending and pending + len(piece) > CHUNK:
                read()
            group.append((owner, seen, piece, breaks))
            pending += len(piece) + 1
            if len(data) > CHUNK:
                seen += int(((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80).sum())
                rest = len(piece.rstrip(b" \t\r\n\x0b\x0c"))
                breaks = piece.count(b"\n", rest) + (0 if rest else breaks)
    flush()
    owner, digest, start, stop, first, size = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 6
    order = np.lexsort((np.arange(len(owner)), digest, owner))
    own = np.zeros(len(owner), bool)
    apart = np.ones(len(owner), bool)
    if len(order):
        same = np.concatenate(([False], (owner[order][1:] == owner[order][:-1]) & (digest[order][1:] == digest[order][:-1])))
        own[order[same]] = True
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]  # the first of equal units
        apart[order] = ~same | (first[order] >= first[head] + size[head])
    keep = np.flatnonzero(apart)  # a unit that overlaps its own first occurrence stays
    owner, columns = owner[keep], [x[keep] for x in (digest, start, stop, first, size, own)]
    offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays([part.column("_rid"), part.column("rank"), *lists], names=["_rid", "rank", "digests", "starts", "stops", "firsts", "sizes", "own"])


def spans(documents: DataFrame) -> DataFrame:
    """``_rid``, ``start``, ``stop`` (characters, end excluded), ``n_words``, ``n_units`` and ``kept_rank`` of what goes.

    ``documents`` has ``_rid``.  ``kept_rank`` is the id of the document that keeps the first unit
    of the span, null where that is the document itself.
    """
    table = stage(cut(documents), "units")
    rows = table.select("_rid", "rank", F.inline(F.arrays_zip("digests", "starts", "stops", "firsts", "sizes", "own")))
    rows = rows.withColumnsRenamed({"digests": "digest", "starts": "start", "stops": "stop", "firsts": "first", "sizes": "size"})
    each = rows.filter(~F.col("own"))
    shared = each.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("rank", "_rid")).alias("keeper")).filter("n > 1")
    shared = stage(shared.select("digest", "n", F.col("keeper._rid").alias("kept_rid"), F.col("keeper.rank").alias("kept_rank")), "shared-units", compact=True)
    place = F.struct("start", "stop", "first", "size").alias("at")
    later = spread_join(each.select("_rid", "digest", place), shared, "digest").filter("_rid <> kept_rid").select("_rid", "at", "kept_rank")
    # a second occurrence in one document goes whoever keeps the first
    inside = rows.filter("own").select("_rid", place, F.lit(None).cast("long").alias("kept_rank"))
    found = later.unionByName(inside).select("_rid", "at.*", "kept_rank").withColumn("end", F.col("first") + F.col("size"))
    order = Window.partitionBy("_rid").orderBy("first", "end", "kept_rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("first")).cast("int")).withColumn("island", F.sum("new").over(order))
    return islands.groupBy("_rid", "island").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.max("end") - F.min("first")).cast("int").alias("n_words"),
        F.count("*").cast("int").alias("n_units"),
        F.min(F.struct("first", "end", "kept_rank")).getField("kept_rank").alias("kept_rank"),
    ).drop("island")


def removed(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``stop``, ``n_words``, ``n_units``, ``kept_doc_id`` and ``span_sha256`` of every removed span."""
    rows = boxed(documents).drop("_row")
    found = spans(rows).groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "n_words", "n_units", "kept_rank"))).alias("_s"))
    each = attached(rows, found, "spans", "inner", "_s").select("doc_id", "text", F.explode("_s").alias("s")).select("doc_id", "text", "s.*")
    kept = F.when(F.col("kept_rank") < (1 << 63) - 1, F.col("kept_rank"))
    return each.select("doc_id", "start", "stop", "n_words", "n_units", kept.alias("kept_doc_id"), F.sha2(F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")), 256).alias("span_sha256"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` without the removed spans; ``n_chars``, if there, is counted anew."""
    rows = boxed(documents)
    found = spans(rows).groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_s"))
    end = F.struct(F.length("text").alias("start"), F.length("text").alias("stop"))
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))), "_s", F.array(end))
    out = attached(rows, found, "spans", lists="_s").withColumn("_c", F.when(F.col("_s").isNotNull(), cuts))
    parts = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.substring(F.col("text"), F.col("_c")[i - 1]["stop"] + 1, F.col("_c")[i]["start"] - F.col("_c")[i - 1]["stop"]))
    return unboxed(out, F.when(F.col("_s").isNull(), F.col("text")).otherwise(F.array_join(parts, "")))
