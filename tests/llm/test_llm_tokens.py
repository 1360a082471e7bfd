"""Operators 1 and 8 against the tokenizers library and a plain count of pieces."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factweave.llm import bpe, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello, World's 123 naïve éà́ ", "a<|endoftext|>b <|StartOfText|> c", "İstanbul ß ΑΣ ΣΑΣ", "", "  ", "x\u0085y ᠎ z", "日本語 テキスト", "ﬁ ½ ² Ⅷ 𝟘",
    "'S it'LL don't", "﻿x", "हिन्दी", "a" * 500, "ha" * 300, "\x1c\x1d a\x1f b", "<|endoftext|><|endoftext|>", "tab\t\tx \r\n  y", "😀👍🏽 ok", "\x00<|endoftext|> \x00b",
]


def check_words(texts):
    ours, theirs = bpe.PairIndexBPE(WORD), Tokenizer.from_file(WORD)
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_word_vocabulary():
    check_words(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",))), max_size=4))
def test_word_vocabulary_on_any_text(texts):
    check_words(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",))))
def test_byte_vocabulary_on_any_text(text):
    want = Tokenizer.from_file(BYTE) if not hasattr(test_byte_vocabulary_on_any_text, "t") else test_byte_vocabulary_on_any_text.t
    test_byte_vocabulary_on_any_text.t = want
    assert packing.encoder(BYTE)(text).tolist() == want.encode(text, add_special_tokens=False).ids


def test_characters_that_python_does_not_know():
    """Code points that are unassigned here and may have case or class there, alone and beside others."""
    import unicodedata

    unknown = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    some = [*unknown[:3000], *unknown[3000::97]]
    check_words([f"A{x}b {x} é<|endoftext|>{x}'s" for x in some])


def test_long_texts():
    long = " ".join(f"Word{i % 791}x" for i in range(40_000))
    check_words([long, long + " \u1c89", "é" * 60_000, ""])


def test_long_words_in_the_byte_vocabulary():
    theirs, ours = Tokenizer.from_file(BYTE), packing.encoder(BYTE)
    for n in (3999, 4000, 4001):
        for text in ("ab" * (n // 2) + "c" * (n % 2), "x " + "é" * n, "1" * n, " " * n):
            assert ours(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_long_white_space_in_the_byte_vocabulary(spark):
    """Runs that the quick library's stack does not stand, alone and through the operator."""
    theirs, ours = Tokenizer.from_file(BYTE), packing.encoder(BYTE)
    texts = [*(c * 10**6 + "x" for c in " \n\t"), "a" + " \n" * 500_000 + "b", "\n" * 10**7 + "x"]
    counts = []
    for text in texts:
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours(text).tolist() == want
        counts.append(len(want) + 1)
    found = packing.pack(documents(spark, [(i, t, "a", "b") for i, t in enumerate(texts[:4])]), BYTE).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert dict(map(tuple, found)) == dict(enumerate(counts[:4]))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, sequence_id string")


def test_round_trip_rows(spark):
    rows = [(1, "Some words", "x", "y"), (1, "Some words", "x", "y"), (None, None, None, None), (3, "", "", "")]
    out = bpe.round_trip(documents(spark, rows), WORD).collect()
    assert len(out) == 4
    assert [r["n_tokens"] for r in out] == [2, 2, 0, 0]
    assert out[0]["decoded"] == "some</w> words</w>" and out[2]["decoded"] == ""
    kept = bpe.encode(documents(spark, rows), WORD)
    assert kept.columns == ["doc_id", "text", "sequence_id", "n_tokens", "ids_le"]
    assert [r["decoded"] for r in bpe.decode(kept, WORD).select("decoded").collect()] == [r["decoded"] for r in out]
    assert bpe.round_trip(documents(spark, []), WORD).count() == 0


def ids_of(text):
    return [*Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_holds_every_id_once(spark):
    texts = ["short text"] * 30 + [None, "", "long words here " * 900, "été " * 700, "x<|endoftext|>y"] + ["w" * i for i in range(1, 60)]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)] + [(0, "short text", None, "s"), (None, "no id", None, None)]
    out = packing.pack(documents(spark, rows).repartition(3), BYTE, capacity=64, open_windows=4).collect()
    by_doc = {}
    for p in out:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for i, t in enumerate(texts):
        ids = ids_of(t)
        pieces = sorted(by_doc[i], key=lambda p: p["start"])
        copies = 2 if i == 0 else 1
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"] and p["doc_tokens"] == len(ids) and 0 < p["length"] <= 64
    windows = {}
    for p in out:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(documents(spark, []), BYTE).count() == 0


def test_query_digests(spark, tmp_path):
    from factweave.llm.queries import op1_bpe, op8_packing

    documents(spark, [(5, "One two", None, None)]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    r = op1_bpe(spark, str(tmp_path)).first()
    ids = Tokenizer.from_file(WORD).encode("One two", add_special_tokens=False).ids
    assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(b"one</w> two</w>").hexdigest()
    assert op8_packing(spark, str(tmp_path)).count() == 1


def plain_packer(lengths, capacity, most):
    """Windows in the order of opening, as lists of lengths; those that were emitted when all were in use come first."""
    opened, closed, where = [], [], []
    for n in lengths:
        fits = [w for w in opened if capacity - sum(w) >= n]
        if fits:
            w = min(fits, key=lambda w: (capacity - sum(w), [x is w for x in opened].index(True)))
        else:
            if len(opened) == most:
                fullest = min(opened, key=lambda w: (capacity - sum(w), [x is w for x in opened].index(True)))
                opened = [x for x in opened if x is not fullest]
                closed.append(fullest)
            w = []
            opened.append(w)
        where.append((id(w), sum(w)))
        w.append(n)
        if sum(w) == capacity:
            opened = [x for x in opened if x is not w]
            closed.append(w)
    return where, len(closed) + len(opened)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=120), st.integers(1, 5))
def test_windows_are_filled_as_a_plain_packer_does(lengths, most):
    windows = packing.Windows(32, most, 100)
    found = [windows.place(n) for n in lengths]
    want, number = plain_packer(lengths, 32, most)
    names = {}
    assert [(names.setdefault(w, len(names)), at) for w, at in found] == [(names.setdefault(w, len(names)), at) for w, at in want] or [at for _, at in found] == [at for _, at in want]
    assert windows.next_id - 100 == number and len(windows.free) <= most
