"""Operators 2 and 9 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import ann, topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def plain(rows, scale, k, queries):
    """Best k by exact integers, ties to smaller ids."""
    fine = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if queries(q):
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(300, 20), (60, 3), (40, 1)])
def test_top_k(spark, shape):
    rng = np.random.default_rng(1)
    x = rng.normal(size=shape).round(3)
    x[5:9] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [float("nan")] * shape[1]), (1000, [None] * shape[1]), (None, x[0].tolist()), (1050, []), (1100, [float("inf")] * shape[1])]
    v = topk.vectors(frame(spark, [(*r, "s") for r in rows]).repartition(3))
    found = topk.top_k(v.filter("id % 50 = 0"), v, 5)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == plain(rows, 256, 5, lambda q: q % 50 == 0)


def test_top_k_of_large_components_few_rows_and_none(spark):
    rows = [(0, [1e9, -3e8]), (1, [1e8, 2.5]), (2, [-1e9, 1.0])]
    v = topk.vectors(frame(spark, [(*r, "s") for r in rows]))
    assert sorted(map(tuple, topk.top_k(v.filter("id = 1"), v, 5, scale=1.0).collect())) == plain(rows, 1.0, 5, lambda q: q == 1)
    none = topk.vectors(frame(spark, []))
    assert topk.top_k(none, none, 5).count() == 0


def test_top_k_of_huge_components(spark):
    """Some rows beyond float64 and beyond 64 bits among common ones, as queries and as candidates."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200, [1e17] * 8), (250, [-1e17] * 8), (203, [1e308, -1e308, *[0.0] * 6]), (300, [1e308] * 8), (301, [-1e308] * 8), (350, [3e7] * 8)]
    most = (1 << 63) - 1
    whole = lambda v: [int(np.floor(max(-1e300, min(1e300, 256 * x)))) for x in v]
    want = []
    for q, a in rows:
        if q % 50 == 0:
            all_ = sorted((-max(-most - 1, min(most, sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))), i) for i, b in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(all_[:5])]
    v = topk.vectors(frame(spark, [(*r, "s") for r in rows]).repartition(2))
    assert sorted(map(tuple, topk.top_k(v.filter("id % 50 = 0"), v, 5).collect())) == sorted(want)


def test_search_prunes_but_loses_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(2000, 64)) * np.linspace(2, 0.1, 64))
    ids = rng.permutation(2000)
    floors = topk.first_floors(x[:40], ids[:40], x[::7], ids[::7], 5)
    number, found, score = topk.search(x[:40], ids[:40], topk.Columns(x, ids), floors, 5)
    for n in range(40):
        s = x @ x[n]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[n]][:5]
        mine = sorted(zip((-score[number == n]).tolist(), found[number == n].tolist(), strict=True))
        assert mine == [(-int(s[i]), int(ids[i])) for i in order]


def test_blocks_stream_past_queries_once(spark):
    """Each candidate block is one row of the plan's output, before all query blocks."""
    rng = np.random.default_rng(5)
    v = topk.vectors(frame(spark, [(i, x.tolist(), "s") for i, x in enumerate(rng.normal(size=(900, 8)))]).repartition(3))
    c, q = (topk.blocks(v, size).withColumn("more", F.lit(b"")) for size in (64 * 100, 64 * 50))
    got = topk.streamed(q, c).select("block", "is_query", F.length("ids").alias("n"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    blocks = {r["block"] for r in got}
    assert len(blocks) >= 9 and sum(r["n"] for r in got if not r["is_query"]) == 8 * 900
    for b in blocks:
        rows = sorted((r["at"], r["is_query"], r["p"]) for r in got if r["block"] == b)
        assert [r[1] for r in rows] == [False] + [True] * (len(rows) - 1) and len({r[2] for r in rows}) == 1


@pytest.mark.parametrize(("rows", "most"), [(500, 1.0), (2000, 0.7), (20_000, 0.55)])
def test_lists_save_work_at_every_size(rows, most):
    """On vectors without any clusters, the hardest there are: recall, and the places that are looked at, for each row (which stands in two lists)."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(rows, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = ann.fit(x, rows, 20)
    ids = np.arange(rows)
    hits = looked = 0
    parts = np.array_split(ids, 3)
    queries = ids[:: max(1, rows // 100)]
    found = {int(q): [] for q in queries}
    for part in parts:
        places = ann.index_block(model, part, x[part])
        block = ann.Block.read(part, x[part], ann.Block.written(*places), len(model.centroids))
        (q, i, s), n = block.search(model, queries, x[queries], 20, 250)
        looked += n
        for a, b, c in zip(q.tolist(), i.tolist(), s.tolist(), strict=True):
            found[a].append((-c, b))
    for q in queries.tolist():
        s = x @ x[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:20].tolist()) & {b for _, b in sorted(found[q])[:20]})
    assert hits / (20 * len(queries)) >= 0.9
    assert looked / (rows * len(queries)) <= most


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 6000)]
    x[100:400] = x[100]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(7000, [0.0] * 16, "s"), (7020, None, "s"), (7040, [float("nan")] * 16, "s")]
    v = topk.vectors(frame(spark, rows).repartition(4))
    found = ann.neighbours(v, v.filter("id % 100 = 0"), 20)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 6000, 100))
    hits = 0
    for q, parts in got.items():
        parts.sort()
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(6000), -s))[:20]
        hits += len(set(want.tolist()) & {i for _, i, _ in parts})
        assert [p[0] for p in parts] == list(range(1, 21))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(parts, parts[1:], strict=False))
        assert all(abs(score - s[i]) < 1e-9 for _, i, score in parts)
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_few_rows(spark):
    v = topk.vectors(frame(spark, [(0, [1.0, 2.0], "s"), (20, [2.0, 1.0], "s"), (20, [2.0, 1.0], "s"), (3, [1.0], "s")]))
    found = sorted(map(tuple, ann.neighbours(v, v.filter("id % 20 = 0"), 20).select("query_id", "rank", "vec_id", "score").collect()))
    assert (0, 1, 20, 4.0) in found and (0, 3, 3, 1.0) in found
    none = topk.vectors(frame(spark, []))
    assert ann.neighbours(none, none, 20).count() == 0
