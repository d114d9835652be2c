"""Sort-means against all distances, in Python's own integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import sort_means as S

SHAPE = "vec_id long, embedding array<double>"


def by_definition(rows, k=8, rounds=10, dims=64, scale=1024):
    points = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    centroids = [p for _, p in order[:k]]
    for step in range(rounds + 1):
        d = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids))
        found = [(i, p, *d(p)) for i, p in points]
        if step < rounds:
            for c in range(len(centroids)):
                own = [p for _, p, _, who in found if who == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    part = lambda c: sum(x for *_, x, who in found if who == c)
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, x, part(c), sum(y for *_, y, _ in found), sha(c)) for i, _, x, c in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_all_distances(spark):
    draw = random.Random(8)
    rows = [(i, [draw.choice([-1.5, -0.0004, 0.0, 0.3, 2.0]) + (i % 5) for _ in range(3)]) for i in range(150)]
    rows += [(5, [1e4, -1e4, 0.5]), (5, [1e4, -1e4, 0.5]), (None, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, SHAPE)
    for k in (1, 4, 8):
        assert rows_of(S.clusters(df, k=k, rounds=3, dims=3)) == by_definition(rows, k, 3, 3)
    assert rows_of(S.clusters(df, k=4, rounds=0, dims=3)) == by_definition(rows, 4, 0, 3)


def test_any_table(spark):
    """Vectors that don't take part, repeated ones, all equal ones (empty clusters), few vectors, clashing names, no rows."""
    nan, inf = float("nan"), float("inf")
    left_out = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [1.0, 2.0, 3.0])]
    rows = left_out + [(i, [1.0, 2.0]) for i in (8, 8, 9, 10, None)]
    df = spark.createDataFrame(rows, SHAPE)
    want = by_definition(rows, 3, 2, 2)
    assert rows_of(S.clusters(df, k=3, rounds=2, dims=2)) == want and len(want) == 5 and {r[1] for r in want} == {0}
    clashes = "kind point cluster distance n sums i s c d cluster_inertia inertia centroid_sha256 a.b tick`ed".split()
    assert rows_of(S.clusters(df.select("*", *(F.lit("x").alias(c) for c in clashes)), k=3, rounds=2, dims=2)) == want
    assert S.clusters(spark.createDataFrame(left_out, SHAPE), dims=2).count() == 0
    assert S.clusters(df.limit(0), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = rows[-2:]
    assert rows_of(S.clusters(spark.createDataFrame(few, SHAPE), k=8, rounds=2, dims=2)) == by_definition(few, 8, 2, 2)
    with pytest.raises(Exception, match="beyond"):
        S.clusters(spark.createDataFrame([(1, [1e30, 0.0])], SHAPE), dims=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([1, 3, 1 << 20, 1 << 27]))
def test_assignment_of_ties(seed, k, size):
    rng = np.random.default_rng(seed)
    points, centroids = rng.integers(-size, size, (80, 3)), rng.integers(-size, size, (k, 3))
    who, d = S.assign(points, rng.integers(0, k, 80), centroids)
    all_d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in points]
    assert d.tolist() == [min(x) for x in all_d] and who.tolist() == [x.index(min(x)) for x in all_d]


def test_scan_stops_early(monkeypatch):
    """Of far clusters no distance is computed."""
    rng = np.random.default_rng(1)
    centroids = np.arange(50)[:, None] * np.array([[1000, 0]])
    before = rng.integers(0, 50, 500)
    points = centroids[before] + rng.integers(-100, 100, (500, 2))
    made = 0
    sort = np.searchsorted

    def counted(a, v, **more):
        nonlocal made
        made += (out := sort(a, v, **more))
        return out

    monkeypatch.setattr(np, "searchsorted", counted)
    who, _ = S.assign(points, before, centroids)
    assert (who == before).all() and made == 0
