"""Bounded clustering against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import centroid_clustering as cc


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for at in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in kept]
        if at < rounds:
            for c in range(len(centroids)):
                if mine := [v for (_, v), o in zip(kept, own) if o == c]:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, o, apart(v, centroids[o])) for (i, v), o in zip(kept, own)]
    part = {c: sum(d for _, o, d in out if o == c) for c in own}
    size = {c: own.count(c) for c in own}
    shown = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in own}
    return sorted(((i if i is not None else -1), o, d, part[o], sum(part.values()), shown[o], size[o]) for i, o, d in out)


def found(spark, rows, **settings_):
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    done = cc.cluster(table, **settings_)
    assert done.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid_size"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in done.collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0]) for i in range(150)]  # a hot vector
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(7, [0.0, 0.0, 0.0, 0.0]), (7, [9.0, 0.0, 0.0, 0.0]), (7, [9.0, 0.0, 0.0, 0.0])]
    assert found(spark, rows, k=11, dims=4, rounds=4) == brute(rows, 11, 4, 4)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]
    assert found(spark, rows, k=5, dims=2, scale=1) == brute(rows, 5, 3, 2, scale=1)
    assert found(spark, rows[:2], k=16, dims=2) == brute(rows[:2], 16, 3, 2)
    assert found(spark, rows[:1], k=16, dims=2) == brute(rows[:1], 16, 3, 2)
    assert found(spark, [(1, None)], k=16, dims=2) == []


def test_components_beyond_a_long_raise(spark):
    with pytest.raises(Exception, match="after scaling"):
        found(spark, [(1, [1e30, 0.0])], k=2, dims=2)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 12), st.integers(1, 4), st.integers(1, 6))
def test_bounds_certify_only_what_is_so(seed, k, kept, steps):
    """Over several moves, of few distinct coordinates so that ties are common, also with fewer and fewer bounds."""
    rng = np.random.default_rng(seed)
    kept = min(kept, k - 1)
    v, centroids = rng.integers(-4, 5, (60, 3)), rng.integers(-4, 5, (k, 3))
    bounds = cc.Bounds.of(v, centroids, kept)
    for step in range(steps):
        after = centroids + rng.integers(-1, 2, (k, 3)) * (rng.random((k, 1)) < 0.4)
        if step == 2:
            bounds.shrink(max(1, kept - 1))
        bounds.move(v, after, np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float)))
        centroids = after
        exact = cc.squares(v, centroids)
        assert (bounds.cluster == exact.argmin(axis=1)).all()
        assert (bounds.upper + 1e-6 >= np.sqrt(exact.min(axis=1))).all()
        for c in range(k):  # every other centroid is no nearer than the bound that stands for it
            for i in range(len(v)):
                if c != bounds.cluster[i]:
                    own = np.flatnonzero(bounds.near[i] == c)
                    low = bounds.lower[i, own[0]] if len(own) else bounds.rest[i]
                    assert low - 1e-6 <= math.sqrt(exact[i, c])


def test_most_vectors_need_no_distances_once_centroids_settle():
    rng = np.random.default_rng(1)
    middle = rng.integers(-500, 500, (16, 8))
    v = np.concatenate([m + rng.integers(-20, 21, (200, 8)) for m in middle])
    bounds = cc.Bounds.of(v, middle, 4)
    bounds.move(v, middle + 1, np.full(16, math.sqrt(8)))
    assert (bounds.looked == 0).mean() > 0.95
