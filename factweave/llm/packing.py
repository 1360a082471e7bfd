"""Operator 8: bounded-space online packing of token sequences.

Each partition keeps at most ``open_windows`` windows open.  A document's ids, closed
by id 0, are cut into whole windows; the rest goes into the open window with the least
sufficient space.  When none has space and all are in use, the fullest is emitted.
The windows still open at a partition's end are few and small; blocks of neighbouring
partitions merge theirs by best fit, and the pieces follow.

Nothing but the pieces leaves a task: ids are packed by length, and only their
checksum is returned.  Results: a null text is packed as an empty one (the closing id
alone); a very long text is encoded whole, long words and long runs of white space by a slower way
that needs no more stack, and cut into as many windows as it takes; of windows with equal space the first
opened is taken; repeated rows, and rows without an id, are packed each; an empty table gives no
pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, text_of, text_slices

CAPACITY = 1024
OPEN_WINDOWS = 64
#: Partitions whose leftover windows meet in one merge task.
MERGE_PARTITIONS = 32

_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("left_open", T.BooleanType()),
])

#: Beyond these scripts the two libraries may know different versions of Unicode; such texts take the slower one.
_RARE = re.compile("[^\x00-ԯḀ-‧　-ヿ一-龥가-힣]")
#: A word of more letters, or a run of as much white space, takes the slower library, whose time and stack stay in proportion.
_LONG_RUN = 4000
_LONG_BLANK = re.compile(r"\s{%d}" % _LONG_RUN)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a byte-level vocabulary in the ``tokenizers`` format, special tokens in the text included.

    Common texts go through ``tiktoken``, which is built here from the same file and is
    faster by a factor of three; the rest goes through ``tokenizers`` itself.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import _byte_chars

    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(_byte_chars())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        long = len(text) > _LONG_RUN and (_LONG_BLANK.search(text) is not None or max(map(len, text.split()), default=0) > _LONG_RUN)
        if not long and not _RARE.search(text):
            try:
                return quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # its patterns gave up
                pass
        return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


class Windows:
    """Open windows of one partition, kept by free space."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.free: list[tuple[int, int]] = []  # (space left, id), ascending

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for ``length`` ids, less than a whole window."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            space, window = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                self.free.pop(0)  # the fullest goes out as it is
            space, window = self.capacity, self.new_id()
        if space > length:
            insort(self.free, (space - length, window))
        return window, self.capacity - space


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents, packed within their partitions; ``left_open`` marks windows to merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        windows = Windows(capacity, open_windows, TaskContext.get().partitionId() << 32)
        waiting: list[list] = []
        out: list[list] = []
        for batch in batches:
            for part in text_slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4", copy=False)
                    n, data = len(ids), ids.tobytes()
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        window, offset = windows.place(size) if size < capacity else (windows.new_id(), 0)
                        waiting.append([doc, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, window, offset])
                still = {window for _, window in windows.free}
                out += [[*p, False] for p in waiting if p[5] not in still]
                waiting = [p for p in waiting if p[5] in still]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
        yield _batch(out + [[*p, True] for p in waiting])

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, _PIECES)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_PIECES.names)


def merged(open_ones: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id``, ``into`` and ``shift`` for each window left open, by best fit, the largest first.

    A group holds the leftovers of MERGE_PARTITIONS partitions, which are bounded by
    the number of open windows.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        free: list[tuple[int, int]] = []
        into, shift = [], []
        group = group.sort_values(["used", "sequence_id"], ascending=[False, True])
        for window, used in zip(group["sequence_id"].tolist(), group["used"].tolist(), strict=True):
            at = bisect_left(free, (used, -1))
            space, target = free.pop(at) if at < len(free) else (capacity, window)
            insort(free, (space - used, target))
            into.append(target)
            shift.append(capacity - space)
        return pd.DataFrame({"sequence_id": group["sequence_id"], "into": into, "shift": shift})

    used = open_ones.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    grouped = used.withColumn("block", F.shiftright(F.shiftright("sequence_id", 32), MERGE_PARTITIONS.bit_length() - 1))
    return grouped.groupBy("block").applyInPandas(fit, "sequence_id long, into long, shift long")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: where its ids come from and in which sequence and where they lie."""
    placed = stage(pieces(documents, path, capacity, open_windows), "packing")
    closed = placed.filter(~F.col("left_open")).drop("left_open")
    left = placed.filter("left_open").drop("left_open")
    moved = left.join(merged(left, capacity), "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")
    )
    return closed.unionByName(moved)
