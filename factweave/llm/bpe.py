"""Operator 1: byte-pair encoding and decoding with a pair occurrence index.

The words of an Arrow slice are laid out once each in one symbol array.  An index
maps every mergeable pair to all positions where it stands; active ranks are taken
in ascending order, each merge is applied at all of its positions together, and
only the pairs beside a merged position are entered anew.  Words do not influence
each other, so this equals merging each word by itself.

Words are split by ``regex``.  Characters that Python's Unicode does not know yet may be known to
``tokenizers``; texts with any of them are lowered and split by its normaliser and pre-tokeniser
instead, and their words are merged like all others.

Results: a null text is encoded as an empty one (no tokens, empty bytes, empty
decoded text).  Strings of special tokens inside a text become their ids.  Rows
are independent: repeated rows give repeated results, an empty table an empty one.
A very long text is a slice by itself.  Other columns stay; those with the names of
results are replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_of, text_slices

#: Words whose ids a worker keeps between slices; the cache is emptied beyond that.
CACHED_WORDS = 300_000


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + spare)
            spare += 1
    return [chars[b] for b in range(256)]


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PairIndexBPE:
    """A word-level BPE vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library = path, None
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.size = size
        self.tokens: list[str | None] = [None] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * size + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ids_of: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words of ``text``; special tokens stand as themselves after a NUL prefix that no word has."""
        words = self.plain_words
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            words = self.library_words
        if self.specials is None or not self.specials.search(text):
            return words(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append("\0" + part)
            else:
                out += words(part)
        return out

    def plain_words(self, text: str) -> list[str]:
        return self.words.findall(self.normal(text))

    def library_words(self, text: str) -> list[str]:
        """The words as ``tokenizers`` sees them, byte by byte."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in word).decode("utf-8") for word, _ in found]

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            # each letter is lowered by itself: a final sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.by_key[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        if not n:
            return [b""] * len(words)
        ends = np.cumsum(sizes) - 1
        full = sizes > 0
        symbols = np.empty(n + 1, np.int64)  # the last place, also reached as -1, stands for "none"
        symbols[:n], symbols[n] = self.inner[data], -1
        symbols[ends[full]] = self.final[data[ends[full]]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[full]], after[n] = n, n
        before[(ends - sizes + 1)[full]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = self._ranks(symbols[places], symbols[after[places]])
            found = ranks >= 0
            if not found.any():
                return
            places, ranks = places[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            firsts = ranks[np.concatenate(([0], cuts))].tolist()
            for rank, part in zip(firsts, np.split(places, cuts) if len(cuts) else [places], strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            at = at[(symbols[at] == a) & (symbols[after[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping places the left one counts
                kept, taken = [], -1
                at = np.unique(at)
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != taken:
                        kept.append(p)
                        taken = q
                at = np.array(kept, np.int64)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = self.made[rank], -2
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            enter(np.unique(np.concatenate((ahead[ahead >= 0], at[beyond < n]))))
        alive = symbols[:n] >= 0
        ids = symbols[:n][alive].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(alive)))
        starts, stops = (4 * upto[ends - sizes + 1]).tolist(), (4 * upto[ends + 1]).tolist()
        return [ids[i:j] for i, j in zip(starts, stops, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        numbers = _Numbered()
        split = [array("I", map(numbers.__getitem__, self.split(t))) for t in texts]
        known = self.ids_of
        if len(known) > CACHED_WORDS:
            known.clear()
        new = [w for w in numbers if w not in known]
        plain = [w for w in new if w[0] != "\0" or w[1:] not in self.special]
        known.update(zip(plain, self.encode_words(plain), strict=True))
        for w in new:
            if w not in known:
                known[w] = self.special[w[1:]].to_bytes(4, "little")
        of = [known[w] for w in numbers]
        return [b"".join(map(of.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces, as a vocabulary without a decoder reads back."""
        found = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return " ".join(t for t in found if t is not None)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def _add(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with more columns, made from the slices of one of its own."""
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + make(part.column(column)), names=[*kept, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids_le`` (little-endian unsigned 32-bit ids) and, if asked for, ``decoded``.

    Columns of ``df`` with these names are replaced.  A null text counts as empty.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        t = tokenizer(path)
        ids = t.encode([x or "" for x in column.to_pylist()])
        out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return out + [pa.array([t.decode(x) for x in ids], pa.string())] * decoded

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType())]
    return _add(df, text, fields + [T.StructField("decoded", T.StringType())] * decoded, make)


def decode(df: DataFrame, path: str, ids: str = "ids_le") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids; null ids give an empty text."""

    def make(column: pa.Array) -> list[pa.Array]:
        t = tokenizer(path)
        return [pa.array([t.decode(x or b"") for x in column.to_pylist()], pa.string())]

    return _add(df, ids, [T.StructField("decoded", T.StringType())], make)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_le`` and ``decoded`` of every document."""
    return encode(documents.select("doc_id", text_of().alias("text")), path, decoded=True).drop("text")
