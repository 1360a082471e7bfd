"""Operator 11 against brute force."""

import math
import random
import re
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, "A", "x" * 100, "é" * 70 + "Z", "a\x00b_c`d{e", "Straße 12,5 ÅB c 漢字かな", "  \n", "-", "I" * 49 + " " + "i" * 48, "word " * 5000]


def grams_of(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain(documents, target, percent, least, buckets, n, seed):
    """Rows as the operator has them, those of equal id in their order."""
    counts = [[0] * buckets for _ in range(2)]
    for side, texts in enumerate((target, [t for _, t in documents])):
        for t in texts:
            for g in grams_of(t, n)[0]:
                counts[side][zlib.crc32(g.encode()) % buckets] += 1
    t_all, s_all = map(sum, counts)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for t, s in zip(*counts, strict=True)]
    rows = []
    for i, (d, text) in enumerate(documents):
        grams, words = grams_of(text, n)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams)
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words, i])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = rank + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("grams", [1, 3])
def test_features_equal_plain_ones(grams):
    column = pa.array(["left out", *ODD, "and", "on"])[1:-1]
    row, bucket, words = resampling.features(column, 1000, grams)
    for i, text in enumerate(ODD):
        want, n = grams_of(text, grams)
        assert words[i] == n
        assert sorted(bucket[row == i].tolist()) == sorted(zlib.crc32(g.encode()) % 1000 for g in want)


def test_checksums_go_on_from_others():
    data = np.frombuffer(b"one two three" + b"x" * 90, np.uint8)
    starts, stops = np.array([0, 4, 8, 13, 2]), np.array([3, 7, 13, 103, 2])
    first = resampling.crc32(data, starts, stops)
    assert first.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)]
    assert resampling.crc32(data, starts, stops, first).tolist() == [zlib.crc32(data[a:b].tobytes() * 2) for a, b in zip(starts, stops, strict=True)]


def test_tournament():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        every = sorted(x for r in runs for x in r)
        assert list(resampling.Tournament(runs)) == every
        assert list(resampling.merged(runs, fan_in=2)) == list(resampling.merged(runs, fan_in=3)) == every


def test_tournament_takes_no_more_than_it_needs():
    taken = [0] * 4

    def run(i):
        for x in range(1000):
            taken[i] += 1
            yield (4 * x + i,)

    assert [x for x, _ in zip(resampling.Tournament([run(i) for i in range(4)]), range(10), strict=False)] == [(i,) for i in range(10)]
    assert sum(taken) <= 10 + 4 + 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, rank string, _rid string")


@pytest.mark.parametrize("sizes", [{}, {"range_rows": 20, "fan_in": 2, "run_rows": 40, "block_rows": 4}])
@pytest.mark.parametrize("grams", [1, 2])
def test_draws_equal_a_plain_version(spark, sizes, grams):
    rng = random.Random(8)
    words = ["the", "of", "Data", "model", "12", "é", "cat", "dog", "tree"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, 9)]) for _ in range(n))
    rows = [(i * 7 % 401, text(rng.randint(0, 60))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, rows[0][1])] * 60 + [(None, text(30)), (None, text(30))]
    target = [text(40) for _ in range(5)] + [None, ""]
    want = plain(rows, target, 10, 20, 97, grams, 2024)
    docs = frame(spark, [(*r, "a", "b", "c") for r in rows]).coalesce(1).repartition(5)
    found = resampling.resampled(docs, frame(spark, [(i, t, "", "", "") for i, t in enumerate(target)]), buckets=97, grams=grams, **sizes)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_nothing_to_draw(spark):
    few = frame(spark, [(1, "a few words", "", "", ""), (2, None, "", "", "")])
    assert [r["rank"] for r in resampling.resampled(few, few).collect()] == [None, None]
    assert resampling.resampled(few.limit(0), few.limit(0)).count() == 0


def test_sql_agrees(spark, tmp_path):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    db = duckdb.connect()
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = db.execute(resampling.SQL)
    columns = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in resampling.resampled(docs, bench).collect())
