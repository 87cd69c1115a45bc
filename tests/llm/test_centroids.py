"""Centroid clustering against its SQL and a plain version in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from factfold.llm import centroids
from tests.oracle import expected, found

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, clusters, rounds, dimensions, seed="2"):
    """Rows of (vec_id, cluster, distance, cluster_inertia, inertia, digest) of (vec_id, vector)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[far(v)[1]].append(v)
        c = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else old for vs, old in zip(own, c, strict=True)]
    at = [far(v) for _, v in kept]
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    sums = [sum(d for d, k in at if k == j) for j in range(len(c))]
    return sorted(((i, k, d, sums[k], sum(sums), digest[k]) for (i, _), (d, k) in zip(kept, at, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_its_sql(spark, data):
    assert found(centroids.op13_centroid_clusters(spark, data)) == expected(centroids.OP13_SQL, data)


def test_odd_vectors_have_no_row_and_others_count(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, 2.0]), (63, [1.0, None, 2.0]), (64, [nan, 0.0, 0.0]), (65, [inf, 0.0, 0.0]), (66, [0.0, -0.0, 0.0]), (66, [0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (5, rows[5][1]), (67, [1e6, -1e6, 3.25])]
    rows += [(100 + i, [0.25, -0.25, 0.125]) for i in range(50)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"{VECTORS}, cluster int, q string")
    for clusters, rounds in ((7, 3), (500, 2), (1, 0)):
        assert got(centroids.cluster(df, clusters, rounds, 3)) == plain(rows, clusters, rounds, 3)


def test_empty_tables_and_ties(spark):
    empty = centroids.cluster(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = [(i, [1.0, 1.0]) for i in range(9)]
    rows = centroids.cluster(spark.createDataFrame(same, VECTORS), 4, 2, 2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in rows} == {(0, 0, 0)} and len(rows) == 9


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i) * 1e5 + 0.3, -1e6 * i]) for i in range(12)]
    assert got(centroids.cluster(spark.createDataFrame(rows, VECTORS), 3, 3, 2)) == plain(rows, 3, 3, 2)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], VECTORS), 3, 3, 2).collect()


def test_shared_vectors_are_joined_by_either_way(spark, monkeypatch):
    rows = [(i, [float(i % 5), 1.0]) for i in range(100)] + [(i, [float(i), 0.0]) for i in range(200, 230)]
    want = plain(rows, 6, 2, 2)
    for heavy in (1, 8, 1_000):
        monkeypatch.setattr(centroids, "HEAVY", heavy)
        assert got(centroids.cluster(spark.createDataFrame(rows, VECTORS), 6, 2, 2)) == want


def test_nearest_by_both_kinds_of_numbers():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-300, 300, (50, 4)), rng.integers(-300, 300, (6, 4))
    at, d = centroids.nearest(x, c)
    scaled_at, scaled = centroids.nearest(x << 20, c << 20)
    assert (at == scaled_at).all() and (scaled == d << 40).all()
