from __future__ import annotations

import math

import numpy as np
import pytest

from factfold.llm import embeddings


def plain(rows, kind=np.float32):
    """(n_links, component) by vec_id, by brute force."""
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    x = np.stack([good[i].astype(kind).astype(float) for i in ids])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = list(range(len(ids)))
    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = label[a], label[b]
        if p != q:
            label = [min(p, q) if v in (p, q) else v for v in label]
    least = {k: min(ids[i] for i in range(len(ids)) if label[i] == k) for k in set(label)}
    found = {i: (int(near[k].sum()), least[label[k]]) for k, i in enumerate(ids)}
    return {i: found.get(i, (0, i)) for i, _ in rows}


def test_query_finds_the_links_of_brute_force(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = plain(rows)
    got = {r.vec_id: r for r in embeddings.op5_embedding_dedup(spark, data).collect()}
    assert got.keys() == want.keys()
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[i][0] for i, r in got.items())
    assert np.mean([r.component_id == want[i][1] for i, r in got.items()]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_many_shards_and_a_large_group(spark):
    rng = np.random.default_rng(5)
    lone = rng.normal(size=(900, 24))
    centre = rng.normal(size=24)
    crowd = centre + 0.08 * rng.normal(size=(400, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([lone, crowd, np.repeat(centre[None], 50, 0)]))]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=150).collect()}
    want = plain(rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([r.component_id == want[i][1] for i, r in got.items()]) > 0.99


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [5e-30, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (6, [1.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, rep int, n int, shard string")
    got = [(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()]
    assert len(got) == len(rows)
    by_id = {i: (n, c) for i, n, c in got}
    assert all(by_id[i] == (0, i) for i in (0, 1, 2, 3, 4, 5, 9, 10))
    assert by_id[6] == by_id[7] == by_id[8] == (2, 6)
    assert by_id[None][0] == 0
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_robust_prune_drops_what_a_nearer_one_covers():
    x = embeddings._unit([[1, 0.0], [1, 0.1], [1, 0.11], [0.0, 1]])
    kept = embeddings.robust_prune(x, np.array([[1, 2, 3]]), degree=3)
    assert kept[0].tolist() == [1, 3]
    assert embeddings.robust_prune(x, np.array([[0, 1]]))[0].tolist() == [1]


@pytest.mark.parametrize("k", [1, 5])
def test_centroids_are_unit_vectors(k):
    x = embeddings._unit(np.random.default_rng(0).normal(size=(50, 8)))
    assert np.linalg.norm(embeddings.centroids(x, k), axis=1) == pytest.approx(1)


def test_audit_sees_classes_whose_every_link_was_missed(spark):
    rng = np.random.default_rng(7)
    pairs = np.repeat(rng.normal(size=(300, 24)), 2, 0) + 0.01 * rng.normal(size=(600, 24))
    crowd = rng.normal(size=24) + 0.05 * rng.normal(size=(300, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([pairs, crowd]))]
    classes = spark.createDataFrame(rows, "rep long, e array<float>, n long")
    found = spark.createDataFrame([(i, 299) for i in range(600, 900)], "rep long, links long")
    assert embeddings.recall_of(embeddings.truth(classes, 0.9, embeddings.AUDIT_ROWS, 900), found) < 0.5


def test_rare_links_are_found_without_comparing_all_pairs(spark, monkeypatch):
    """Planted vectors tell how much was found where hardly anything links, and change nothing."""
    rng, calls, linked = np.random.default_rng(11), [], embeddings._linked
    monkeypatch.setattr(embeddings, "_linked", lambda *a: calls.append(a) or linked(*a))
    x = rng.normal(size=(9_000, 32))
    x[20:40] = x[:20] + 0.03 * rng.normal(size=(20, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(calls) <= 2 and all(c[4] for c in calls)  # never all pairs
    assert all(r.recall >= embeddings.RECALL for r in got)
    links = {r.vec_id: (r.n_links, r.component_id) for r in got if r.n_links}
    assert links == {i: (1, i % 20) for i in range(40)} and len(got) == 9_000
    classes = spark.createDataFrame([(i, v, 1) for i, v in rows], "rep long, e array<float>, n long")
    known = embeddings.truth(classes.unionByName(embeddings.plant(classes, 9_000, 0.9, 0, 8_999)), 0.9, embeddings.AUDIT_ROWS, 9_000)
    assert known.count() >= 50


def test_planted_vectors_keep_their_cosine_and_their_numbers(spark):
    rows = [(-(1 << 63), [1.0, 0.0], 1), (5, [0.0, 3.0], 2)]
    classes = spark.createDataFrame(rows, "rep long, e array<float>, n long")
    got = embeddings.plant(classes, 2, 0.9, -(1 << 63), 5).collect()
    assert [r.rep for r in got] == [6, 7] and all(r.n == 0 for r in got)
    assert all(0.9 < embeddings._unit([r.e])[0] @ embeddings._unit([e])[0] < 1 for r, (_, e, _) in zip(got, rows, strict=True))
    lone = embeddings.plant(spark.createDataFrame([(3, [2.0], 1)], "rep long, e array<float>, n long"), 1, 0.9, 3, 3).collect()
    assert [r.rep for r in lone] == [2]


def test_the_last_way_is_exact(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "RECALL", 2.0)
    monkeypatch.setattr(embeddings, "ROUNDS", 1)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(150, 12)), 2, 0) + 0.12 * rng.normal(size=(300, 12)), rng.normal(size=(100, 12))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=40).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain(rows)


@pytest.mark.parametrize("exact", [True, False])
def test_shards_are_split_until_they_are_small(spark, monkeypatch, exact):
    monkeypatch.setattr(embeddings, "MAX_CENTROIDS", 2)
    monkeypatch.setattr(embeddings, "FANOUT", 4)
    monkeypatch.setattr(embeddings, "DEALT", 200)
    if exact:
        monkeypatch.setattr(embeddings, "RECALL", 2.0)
        monkeypatch.setattr(embeddings, "ROUNDS", 1)
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(300, 12)), 2, 0) + 0.12 * rng.normal(size=(600, 12)), rng.normal(size=12) + 0.1 * rng.normal(size=(300, 12))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = {r.vec_id: r for r in embeddings.near_vectors(df, shard_rows=30).collect()}, plain(rows)
    if exact:
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert {r.recall for r in got.values()} <= {1.0} or min(r.recall for r in got.values()) >= embeddings.RECALL
    classes = spark.createDataFrame([(i, v, 1) for i, v in rows], "rep long, e array<float>, n long")
    split = embeddings.split(embeddings.route(classes, embeddings.centroids(embeddings._unit(x), 2), 0.3), 0.3, 30)
    homes = split.where("home").groupBy("shard").count().collect()
    assert sum(r["count"] for r in homes) == len(rows) and max(r["count"] for r in homes) <= 120


def test_doubles_stay_doubles_and_lengths_stay_apart(spark):
    rows = [(0, [1e300, 0.0]), (1, [1e-300, 0.0]), (2, [1.0, 1e-9]), (3, [0.9, math.sqrt(1 - 0.81) * (1 - 1e-9)]), (4, [0.9, math.sqrt(1 - 0.81) * (1 + 1e-9)]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 1e-9, 0.0]), (7, [-1.0, 0.0]), (8, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    flat = plain([r for r in rows if len(r[1]) == 2], float)
    assert {i: got[i] for i in flat} == flat and flat[0][0] in (3, 4)
    assert got[5] == got[6] == (1, 5) and got[8] == (0, 8)


def test_many_shards_miss_no_more_links_than_few(spark, monkeypatch):
    """Pairs near the threshold whose nearest shards differ are found by the first search, however many shards there are."""
    rng, calls, linked = np.random.default_rng(12), [], embeddings._linked
    monkeypatch.setattr(embeddings, "_linked", lambda *a: calls.append(a) or linked(*a))
    monkeypatch.setattr(embeddings, "SAMPLE", 500)  # few of the vectors shape the centroids, as in a large table
    x = embeddings._unit(rng.normal(size=(3_000, 64)))
    aside = rng.normal(size=(500, 64))
    aside = embeddings._unit(aside - (aside * x[:500]).sum(axis=1, keepdims=True) * x[:500])
    cosine = rng.uniform(0.902, 0.94, (500, 1))
    x = np.concatenate([x, cosine * x[:500] + np.sqrt(1 - cosine * cosine) * aside])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=20).collect()}
    want = plain(rows)
    assert len(calls) == 1 and all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_classes_near_to_too_many_shards_are_counted_once(spark, monkeypatch):
    """A pair is counted once whether both, one or none of its classes are members of all shards that they are near to."""
    monkeypatch.setattr(embeddings, "PLACES", 3)
    rng = np.random.default_rng(13)
    x = np.concatenate([np.repeat(rng.normal(size=(300, 12)), 2, 0) + 0.1 * rng.normal(size=(600, 12)), rng.normal(size=12) + 0.1 * rng.normal(size=(200, 12))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    placed = embeddings.place(spark.createDataFrame([(i, v, 1) for i, v in rows], "rep long, e array<float>, n long"), embeddings.centroids(embeddings._unit(x), 20), 0.3)
    assert 0 < placed.where("size(places) > 3").count() < 800
    got, want = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=40).collect(), plain(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * sum(n for n, _ in want.values())


def test_a_vertex_near_to_many_and_a_crowd_are_reached_from_each_vertex():
    rng = np.random.default_rng(14)
    centre = rng.normal(size=64)
    x = embeddings._unit(np.concatenate([centre[None], centre + 0.1 * rng.normal(size=(400, 64)), rng.normal(size=(600, 64))]))
    low, (first, flat) = x.astype(np.float32), embeddings.build(x)
    block = np.arange(256)
    q, v = embeddings.greedy_search(low, first, flat, block, block, low[block], 0.9, embeddings.BEAM)
    assert (np.bincount(q) >= 401).all() and np.isin(np.arange(256) * 1001, q * 1001 + v).all()


def test_links_count_in_the_first_shared_shard_only():
    import pyarrow as pa

    table = pa.table({
        "rep": pa.array([1, 2, 3, 4], pa.int64()), "e": pa.array([[1.0, 0.0], [1.0, 0.01], [1.0, 0.02], [1.0, 0.03]], pa.list_(pa.float32())), "n": pa.array([1, 1, 1, 1], pa.int64()),
        "before": pa.array([[0], [0, 1], [], None], pa.list_(pa.int32())), "member": [True, True, True, False], "home": [True, False, True, False], "asks": [True] * 4,
    })
    for beam in (2, None):
        got = {r["rep"]: (r["links"], r["root"]) for r in embeddings.search(table, 0.9, beam).to_pylist()}
        # 1 and 2 meet in shard 0; 4 is no member and counts those that are at home here
        assert got == {1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (2, 1)}


def test_nearest_are_the_highest_scores():
    rng = np.random.default_rng(15)
    for scores in (rng.normal(size=(40, 2_000)), np.repeat(rng.normal(size=(40, 1)), 2_000, 1), rng.normal(size=(40, 50))):
        got = np.take_along_axis(scores, embeddings.nearest(scores, 20), 1)
        assert (np.sort(got) == np.sort(scores)[:, -20:]).all()
        assert all(len(set(r)) == 20 for r in embeddings.nearest(scores, 20).tolist())


def test_lists_followed_for_all_queries_at_once_lead_to_the_same(monkeypatch):
    rng = np.random.default_rng(16)
    x = embeddings._unit(np.concatenate([rng.normal(size=32) + 0.1 * rng.normal(size=(150, 32)), rng.normal(size=(250, 32))]))
    low, (first, flat), block = x.astype(np.float32), embeddings.build(x), np.arange(100, 200)
    search = lambda: {*zip(*map(np.ndarray.tolist, embeddings.greedy_search(low, first, flat, np.arange(100), block, low[block], 0.9, 8)), strict=True)}
    one_by_one = search()
    monkeypatch.setattr(embeddings, "WAVE", 0)
    assert search() == one_by_one and len(one_by_one) >= 50 * 150 + 50
