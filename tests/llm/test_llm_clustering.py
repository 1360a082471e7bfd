"""Operator 13 against plain rounds with full scans."""

from hashlib import sha256

import numpy as np
import pytest

from factweave.llm import clustering


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance string, ids string")


def plain(rows, k, rounds, scale=256.0, dimensions=64):
    """Id, number, distance and centroid of each vector that takes part, by plain integers."""
    most = clustering.limit(dimensions)
    fine = [(i, [max(-most, min(most, int(np.floor(max(-1e30, min(1e30, scale * x)))))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(fine, key=lambda r: ("~" if r[0] is None else sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        near = [min(range(len(c)), key=lambda j: (gap(v, c[j]), j)) for _, v in fine]
        for j in range(len(c)):
            own = [v for (_, v), n in zip(fine, near, strict=True) if n == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = [min((gap(v, c[j]), j) for j in range(len(c))) for _, v in fine]
    name = lambda x: sha256(",".join(map(str, x)).encode()).hexdigest()
    most_long = (1 << 63) - 1
    of = {j: min(most_long, sum(d for d, n in near if n == j)) for j in range(len(c))}
    return [(i, n, d, of[n], min(most_long, sum(x for x, _ in near)), name(c[n])) for (i, _), (d, n) in zip(fine, near, strict=True)]


def found(spark, rows, k, rounds=5, **more):
    out = clustering.cluster(clustering.kept(frame(spark, [(*r, "a", "b", "c") for r in rows]).repartition(3)), k, rounds, **more)
    return sorted(map(tuple, out.rows.collect()), key=str), out


@pytest.mark.parametrize("block_bytes", [2 << 20, 64 * 4 * 7])
def test_clusters_equal_plain_rounds(spark, block_bytes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, 400)] + 0.2 * rng.normal(size=(400, 64))).round(3)
    x[50:60] = x[40]  # equal vectors, and equal centroids where they are chosen
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[9].tolist()), (None, x[0].tolist()), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] * 64), (904, [float("-inf")] * 64), (905, [])]
    got, out = found(spark, rows, 15, block_bytes=block_bytes)
    assert got == sorted(plain(rows, 15, 5), key=str)
    assert out.vectors == 402 and out.scanned[0] == 402 and sum(out.scanned[1:]) < 3 * 402  # of 4 * 402
    assert out.rows.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]


def test_ties_go_to_the_smaller_number(spark):
    at = lambda *x: [float(v) for v in (*x, *[0] * (64 - len(x)))]
    rows = [(i, at(i % 5, i % 3)) for i in range(60)]
    for k in (2, 7, 60, 100):
        assert found(spark, rows, k)[0] == sorted(plain(rows, k, 5), key=str)


def test_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (10.0 ** rng.integers(0, 7, 64) * rng.normal(size=64)).tolist()) for i in range(40)] + [(77, [1e300] * 64), (78, [-1e308] * 64), (79, [1e17] * 64)]
    assert found(spark, rows, 6)[0] == sorted(plain(rows, 6, 5), key=str)


def test_none_and_one(spark):
    assert found(spark, [], 40)[0] == []
    assert found(spark, [(5, [0.5] * 64)], 40)[0] == plain([(5, [0.5] * 64)], 40, 5)


def test_bounds_never_skip_a_vector_that_moves():
    """Random rounds with drifts of all sizes, each against a full scan."""
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 8)).astype(np.int32)
    now = clustering.Round(x[:10].astype(np.int64), np.zeros(10))
    state = (np.full(500, -1, np.int32), np.full(500, np.inf), np.full(500, -np.inf))
    for size in (100, 30, 3, 1, 0, 1, 200):
        *state, scanned = now.assign(x, *state)
        d = clustering.distances(x, now.centroids)
        assert (state[0] == d.argmin(1)).all() and scanned <= 500
        assert (state[1] >= np.sqrt(d.min(1))).all() and (state[2] <= np.sqrt(np.partition(d, 1, axis=1)[:, 1]) + 1e-9).all()
        moved = now.centroids + rng.integers(-size, size + 1, now.centroids.shape)
        now = clustering.Round(moved, np.sqrt(((moved - now.centroids) ** 2).sum(1).astype(float)))
