"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are one class. Centroids of a bounded sample cut the classes into cluster shards, which overlap: a class is a member
of its nearest shard and of each in which a partner may have its nearest. A pair is compared wherever both are members and counted in
the first shard that they share, so a link is missed only where two classes share none, and that hardly depends on the number of shards. Each
shard links its members to their nearest ones, prunes the lists robustly, and searches for each member: a greedy search from its own
vertex, which goes on expanding every vertex near the threshold until there is none. What it finds is verified by cosine in
double precision. The result is audited against brute force on classes drawn without regard to it and on planted vectors: near
copies of drawn classes, which take part in the search as any vector does but count for nobody, so that there are links to be missed
however rare they are in the table. A recall below the target, of links or of classes, widens the search. If it is still below after the last
round, every class is compared with all members of every shard that can hold a partner, which misses none.

A shard of too many rows is clustered again, by centroids of a bounded sample of its own, until none is left; there each row is a member
of one part, and is searched for, from the part's medoids, in the others that may hold a partner. So shards keep their
size at any number of vectors. A class near to more than PLACES shards is treated in the same way from the start. Where many classes are
searched in one shard they are dealt to several tasks, each with all members of
it. A task gives one row per class that has links and a spanning star per linked group, never the pairs of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import components, cut, read

THRESHOLD, SHARD_ROWS, SAMPLE, MAX_CENTROIDS = 0.9, 1_000, 16_384, 2_048
#: Splitting of large shards: from how many times SHARD_ROWS on (nearest ones, members), into how many at most, rows of its sample, rows dealt at a time, levels.
SPLIT, CROWDED, FANOUT, SHARD_SAMPLE, DEALT, LEVELS = 4, 24, 32, 2_048, 20_000, 16
DEGREE, NEAREST, SURE, ALPHA, BEAM, SLACK, MARGIN = 24, 32, 4, 1.2, 2, 0.1, 1.0
#: The beam of a search that doesn't start at its own vertex, in beams; shards that a class is a member of at most; links that are followed one by one.
FAR, PLACES, WAVE = 12, 64, 1 << 20
AUDIT_ROWS, PLANTED, RECALL, ROUNDS, BLOCK = 4_096, 512, 0.98, 4, 256
ROUTED = "shard string, rep long, e {}, n long, before array<int>, member boolean, home boolean"


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge vectors keep their direction
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(rows) -> np.ndarray:
    return _scaled(np.stack([np.asarray(r, np.float64) for r in rows]))


def _vectors(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of an Arrow column of lists of one length."""
    return _scaled(pc.list_flatten(lists).to_numpy().reshape(len(lists), -1)) if len(lists) else np.zeros((0, 1))


def _dots(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the rows a of x with the rows b of y, some at a time."""
    step, out = max(1, (1 << 21) // x.shape[1]), np.empty(len(a), x.dtype)
    for i in range(0, len(a), step):
        out[i : i + step] = np.einsum("ij,ij->i", x[a[i : i + step]], y[b[i : i + step]])
    return out


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(42)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, first: int = 0) -> list[np.ndarray]:
    """Of each vertex's candidates, nearest first, those that no kept one covers alpha times better than the vertex does. The rows of near are those of the vertices from first on."""
    out, step = [], max(1, min(BLOCK, (1 << 22) // max(1, near.shape[1] * x.shape[1])))
    for at in range(0, len(near), step):
        vertex = np.arange(first + at, first + min(at + step, len(near)))
        candidates = near[at : at + step]
        own = 2 - 2 * np.einsum("ijk,ik->ij", x[candidates], x[vertex])
        own[candidates == vertex[:, None]] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
        y = x[candidates]
        covered = alpha * alpha * (2 - 2 * (y @ y.transpose(0, 2, 1))) <= own[:, None, :]
        alive, kept, count = np.isfinite(own), np.zeros(own.shape, bool), np.zeros(len(own), int)
        for i in range(own.shape[1]):
            kept[:, i] = alive[:, i] & (count < degree)
            count += kept[:, i]
            alive &= ~(covered[:, i] & kept[:, i, None])
        out += np.split(candidates[kept], np.cumsum(count)[:-1])
    return out


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The different ones in order; sorting whole numbers is faster than hashing them."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=numbers[:1] - 1) > 0]


def nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k highest scores of each row, in any order.

    In long rows only what exceeds a bound is compared, which about twice as many do; one column in eight tells it. Where fewer than k do, all are.
    """
    if scores.shape[1] < 64 * k:
        return np.argpartition(-scores, k - 1, axis=1)[:, :k]
    row, column = np.divmod(np.flatnonzero(scores > -np.partition(-scores[:, ::8], k // 4, axis=1)[:, k // 4, None]), scores.shape[1])
    count = np.bincount(row, minlength=len(scores))
    few = count < k
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    value, names = np.full((len(scores), max(k, count.max())), np.inf, scores.dtype), np.zeros((len(scores), max(k, count.max())), np.int64)
    value[row, at], names[row, at] = -scores[row, column], column
    out = np.take_along_axis(names, np.argpartition(value, k - 1, axis=1)[:, :k], 1)
    if few.any():
        out[few] = np.argpartition(-scores[few], k - 1, axis=1)[:, :k]
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, flat) adjacency lists of one shard: pruned nearest members, links back, and a few links chosen at random. The list of
    v is flat[first[v]:first[v + 1]]."""
    m, lists = len(x), []
    low, k = x.astype(np.float32), min(NEAREST + 1, m)
    for i in range(0, m, BLOCK):
        lists += robust_prune(low, nearest(low[i : i + BLOCK] @ low.T, k), first=i)
    degree = np.array([len(a) for a in lists])
    v, u = np.repeat(np.arange(m), degree), np.concatenate(lists).astype(np.int64)
    place = np.arange(len(v)) - np.repeat(np.cumsum(degree) - degree, degree)
    order = np.argsort(u * (degree.max() + 1) + place, kind="stable")
    rank = np.arange(len(v)) - np.searchsorted(u[order], u[order])
    back = order[(rank < DEGREE) | (place[order] < SURE)]  # the nearest links lead back even to a vertex that many are near to
    far = np.random.default_rng(42).integers(0, m, (m, 3))
    links = _distinct(np.concatenate([v * m + u, u[back] * m + v[back], (np.arange(m)[:, None] * m + far).ravel()]))
    src, dst = np.divmod(links, m)
    src, dst = src[src != dst], dst[src != dst]
    return np.searchsorted(src, np.arange(m + 1)), dst


def _followed(first: np.ndarray, flat: np.ndarray, q: np.ndarray, v: np.ndarray, queries: int) -> np.ndarray:
    """(query, vertex) as a table: whether the vertex is on the list of one that the query expands. The queries of a vertex are bits
    of words, so that a crowd's lists are followed once for all queries."""
    m = len(first) - 1
    expanded = np.zeros((m, -(-queries // 64) * 64), bool)
    expanded[v, q] = True
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
    words = np.packbits(expanded, axis=1).view(np.uint64)[np.repeat(np.arange(m), np.diff(first))[order]]
    out = np.zeros(expanded.shape, bool)
    out[flat[order][starts]] = np.unpackbits(np.bitwise_or.reduceat(words, starts, axis=0).view(np.uint8), axis=1)
    return np.ascontiguousarray(out.T[:queries])


def greedy_search(x: np.ndarray, first: np.ndarray, flat: np.ndarray, q: np.ndarray, v: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vertex) pairs of cosine near or over the threshold, by range-expanding greedy search for a block of queries from the
    vertices v of the queries q. x and queries are of single precision."""
    m, used, step, found = len(x), 0, min(4, beam), []
    seen = np.zeros(len(queries) * m, bool)
    pool, worth = np.zeros(0, np.int64), np.zeros(0, np.float32)  # the best of what was seen and not expanded yet
    while True:
        pairs = q * m + v
        seen[pairs] = True
        if len(pairs) * 16 > len(queries) * m:  # in a crowd most pairs are asked for
            value = (queries @ x.T).ravel()[pairs]
        else:
            value = _dots(queries, q, x, v)
        close = value >= threshold - SLACK
        found.append(pairs[value >= threshold - 1e-3])
        frontier = [pairs[close]]
        if used < beam:
            pool, worth = np.concatenate([pool, pairs[~close]]), np.concatenate([worth, value[~close]])
            order = np.lexsort((-worth, pool // m))
            pool, worth = pool[order], worth[order]
            of = pool // m
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            frontier.append(pool[rank < step])
            rest = (rank >= step) & (rank < beam)
            pool, worth, used = pool[rest], worth[rest], used + step
        q, v = np.divmod(np.concatenate(frontier), m)
        if not len(q):
            return np.divmod(np.concatenate(found), m)
        count = first[v + 1] - first[v]
        if count.sum() > WAVE:
            pairs = np.flatnonzero(_followed(first, flat, q, v, len(queries)).ravel() & ~seen)
        else:
            to = flat[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[v], count)]
            pairs = np.repeat(q * m, count) + to
            pairs = _distinct(pairs[~seen[pairs]])
        q, v = np.divmod(pairs, m)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of n vertices reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _bits(before: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """For each of the rows the set of its earlier shards, as bits."""
    size = pc.fill_null(pc.list_value_length(before), 0).to_numpy()
    names, place = np.unique(pc.list_flatten(before).to_numpy(), return_inverse=True)
    bits = np.zeros((len(size), len(names) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(size)), size), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits[rows]


def search(shard: pa.Table, threshold: float, beam: int | None) -> pa.Table:
    """(rep, links, root): for each class with links of those searched in this task, the vectors linked to it, and the
    smallest class of its linked group here. A link counts in the first shard that both are members of; that of a class without
    a list of earlier shards where the other is at home. Without a beam every member is compared."""
    member = shard["member"].to_numpy()
    rows = np.lexsort((shard["rep"].to_numpy(), ~member))
    ids, n, home = (shard[c].to_numpy()[rows] for c in ("rep", "n", "home"))
    x, bits, listed = _vectors(shard["e"])[rows], _bits(shard["before"], rows), shard["before"].is_valid().to_numpy()[rows]
    asks, m = np.flatnonzero(shard["asks"].to_numpy()[rows]), int(member.sum())
    links, label, low = np.zeros(len(ids), np.int64), np.argsort(np.argsort(ids, kind="stable"), kind="stable"), x.astype(np.float32)
    names = np.sort(ids)  # a label is a place among them, so that the smallest label is the smallest class
    own, asks = label, asks if m else asks[:0]  # without a member none of it has a home here
    if beam and len(asks):
        first, flat = build(x[:m])
        c = centroids(x[:m], min(8, m), 4)
        starts = np.unique((x[:m] @ c.T).argmax(axis=0))
    inner = asks[asks < m]
    for block, far in [(some[i : i + BLOCK], k) for k, some in enumerate((inner, asks[asks >= m])) for i in range(0, len(some), BLOCK)]:
        if beam:
            at = (np.repeat(np.arange(len(block)), len(starts)), np.tile(starts, len(block))) if far else (np.arange(len(block)), block)
            q, v = greedy_search(low[:m], first, flat, *at, low[block], threshold, beam * (FAR if far else 1))
        else:
            q, v = np.nonzero(low[block] @ low[:m].T >= threshold - 1e-3)
        q = block[q]
        for j in range(0, len(q), 200_000):
            a, b = q[j : j + 200_000], v[j : j + 200_000]
            ok = (ids[a] != ids[b]) & np.where(listed[a] & listed[b], ~(bits[a] & bits[b]).any(axis=1), home[b])
            a, b = a[ok], b[ok]
            ok = _dots(x, a, x, b) >= threshold
            a, b = a[ok], b[ok]
            np.add.at(links, a, n[b])
            ok = (n[a] > 0) & (n[b] > 0)  # planted vectors join no groups
            p, r = label[a[ok]], label[b[ok]]
            if (p != r).any():
                label = _roots(len(ids), p[p != r], r[p != r])[label]
    keep = np.flatnonzero((links > 0) | (label != own))  # what links with nothing has no row
    return pa.table({"rep": ids[keep], "links": links[keep], "root": names[label[keep]]})


def _dealt(x: np.ndarray, c: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cluster, is nearest) of the clusters in which a partner of each vector may have its nearest, its own among them.

    A vector within the threshold's angle of q is nearer to centroid c than to q's own only if q lies within
    tan(angle) * |c - own| of the plane between them; limit has what of that counts (``_limit``).
    """
    dots = x @ c.T
    own = dots.argmax(axis=1)
    row, cluster = np.nonzero(dots.max(axis=1)[:, None] - dots <= limit[own])
    return row, cluster, own[row] == cluster


def _limit(c: np.ndarray, reach: float) -> np.ndarray:
    return reach * np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) + 1e-9


def place(classes: DataFrame, c: np.ndarray, reach: float) -> DataFrame:
    """(rep, e, n, near, places): each class with its nearest shard and, in order, those in which a partner may have its nearest."""

    def run(batches):
        limit = _limit(c, reach)
        for batch in batches:
            x, near, size, places = _vectors(batch["e"]), [], [], []
            for i in range(0, len(x), 4 * BLOCK):
                row, cluster, nearest = _dealt(x[i : i + 4 * BLOCK], c, limit)
                near.append(cluster[nearest])
                size.append(np.bincount(row, minlength=len(x[i : i + 4 * BLOCK])))
                places.append(cluster)
            if len(x):
                first = np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(places).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["rep"], batch["e"], batch["n"], pa.array(np.concatenate(near).astype(np.int32)), lists], ["rep", "e", "n", "near", "places"])

    return classes.select("rep", "e", "n").mapInArrow(run, f"rep long, e {classes.schema['e'].dataType.simpleString()}, n long, near int, places array<int>")


def _routed(placed: DataFrame, most: int) -> DataFrame:
    """ROUTED rows of placed: a class of at most ``most`` places is a member of them all, another of its nearest only."""
    few, at = F.size("places") <= most, F.explode("places").alias("at")
    each = placed.select("rep", "e", "n", "near", at, F.when(few, F.col("places")).alias("places"))
    home = F.col("at") == F.col("near")
    before = F.filter("places", lambda p: p < F.col("at"))
    return each.select(F.col("at").cast("string").alias("shard"), "rep", "e", "n", before.alias("before"), (F.col("places").isNotNull() | home).alias("member"), home.alias("home"))


def route(classes: DataFrame, c: np.ndarray, reach: float) -> DataFrame:
    """ROUTED rows: each class to the shards that it is a member of and to those in which it is searched."""
    return _routed(place(classes, c, reach), PLACES)


def split(routed: DataFrame, reach: float, shard_rows: int) -> DataFrame:
    """routed with every shard of more than SPLIT * shard_rows rows at home or CROWDED * shard_rows members clustered again, until
    there is none.

    A shard's centroids come from a bounded sample of it; its rows are dealt in blocks, so that no task holds a shard.
    """
    kind, done = routed.schema["e"].dataType.simpleString(), []

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        parts = max(2, -(-sample["homes"].iloc[0] // shard_rows), -(-SPLIT * sample["members"].iloc[0] // (CROWDED * shard_rows)))
        k = min(FANOUT, len(sample), int(parts))
        return pd.DataFrame({"shard": [sample["shard"].iloc[0]], "blocks": [int(sample["blocks"].iloc[0])], "c": [centroids(_unit(sample.sort_values("rep")["e"]), k).ravel().tolist()]})

    def deal(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"shard": [], "rep": np.zeros(0, np.int64), "e": [], "n": np.zeros(0, np.int64), "before": [], "member": np.zeros(0, bool), "home": np.zeros(0, bool)})
        x = _unit(rows["e"])
        c = np.array(fits["c"].iloc[0], float).reshape(-1, x.shape[1])
        row, cluster, nearest = _dealt(x, c, _limit(c, reach))
        names = np.array([f"{fits['shard'].iloc[0]}.{k}" for k in range(len(c))], object)
        own = {k: rows[k].to_numpy()[row] for k in ("rep", "e", "n", "before", "member", "home")}
        return pd.DataFrame({"shard": names[cluster]} | own | {k: own[k].astype(bool) & nearest for k in ("member", "home")})

    for level in range(LEVELS):
        size = routed.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count_if("member").alias("members"), F.ceil(F.count("*") / DEALT).cast("int").alias("blocks"))
        heavy = cut(size.where((F.col("homes") > SPLIT * shard_rows) | (F.col("members") > CROWDED * shard_rows)))
        if heavy.isEmpty():
            break
        chance = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 20)) < (1 << 20) * F.least(F.lit(1.0), SHARD_SAMPLE / F.col("members"))
        fits = routed.where("member").join(heavy, "shard").where(chance).select("shard", "rep", "e", "homes", "members", "blocks").groupBy("shard").applyInPandas(fit, "shard string, blocks int, c array<double>")
        fits = cut(fits)
        each = fits.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "c")
        rows = routed.join(fits.select("shard", "blocks"), "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
        dealt = rows.groupBy("shard", "block").cogroup(each.groupBy("shard", "block")).applyInPandas(deal, ROUTED.format(kind))
        done.append(routed.join(fits.select("shard"), "shard", "left_anti"))
        routed = cut(dealt)
    else:
        raise RuntimeError(f"shards are still too large after {LEVELS} levels")
    for part in done:
        routed = routed.unionByName(part)
    return routed


def _linked(classes: DataFrame, total: int, threshold: float, margin: float, beam: int | None, shard_rows: int) -> DataFrame:
    """What ``search`` finds in all shards. ``margin`` standard deviations of a random direction bound the part of tan(angle) that
    points to a centroid; from the square root of the dimension on the bound is whole. A pair is missed where neither has
    the other's nearest shard nor a third one in its bounds; within a shard that was split, where one is outside the other's, which are twice as wide."""
    k = max(1, min(MAX_CENTROIDS, math.ceil(total / shard_rows)))
    part = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / total))
    sample = classes.where(part).select("e").limit(2 * SAMPLE).toPandas()["e"]
    c = centroids(_unit(sample if len(sample) else classes.limit(1).toPandas()["e"]), k)
    reach, inner = (math.sqrt(1 - threshold * threshold) / threshold * min(1.0, w * margin / math.sqrt(c.shape[1])) for w in (1, 2))
    routed = split(_routed(cut(place(classes, c, reach)), PLACES if beam else 0), inner, shard_rows)
    asked = routed.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("member")) / (SPLIT * shard_rows))).cast("int").alias("blocks"))
    dealt = routed.join(asked, "shard").select("*", F.when(F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))).alias("into"))
    tasks = dealt.select("shard", "rep", "e", "n", "before", "member", "home", F.explode("into").alias("block")).withColumn("asks", ~F.col("member") | (F.col("block") == 0))
    return tasks.groupBy("shard", "block").applyInArrow(lambda s: search(s, threshold, beam), "rep long, links long, root long")


def plant(classes: DataFrame, total: int, threshold: float, low: int, high: int, rows: int = PLANTED) -> DataFrame:
    """(rep, e, n = 0): for about ``rows`` classes drawn by hash a vector at a cosine anywhere between the threshold and one,
    in a random direction. Their numbers lie below low, the least that a class of any length has, or above high where there is no room."""
    part = F.pmod(F.xxhash64("rep", F.lit("plant")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / total))
    drawn = classes.where(part).select("rep", "e").toPandas()
    drawn = (drawn if len(drawn) else classes.select("rep", "e").limit(1).toPandas()).sort_values("rep")
    x, rng = _unit(drawn["e"]), np.random.default_rng(42)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    cosine = (threshold + (1 - threshold) * rng.uniform(0.02, 0.98, len(x)))[:, None]
    near = cosine * x + np.sqrt(1 - cosine * cosine) * aside
    ids = [low - 1 - i if low > -(1 << 62) else high + 1 + i for i in range(len(x))]
    rows_ = pd.DataFrame({"rep": ids, "e": near.tolist(), "n": 0})
    return classes.sparkSession.createDataFrame(rows_, classes.select("rep", "e", "n").schema)


def truth(classes: DataFrame, threshold: float, rows: int, total: int) -> DataFrame:
    """(rep, true): for about ``rows`` classes, drawn by hash and not by what was found, and all planted ones how many vectors brute
    force links them with."""
    part = F.pmod(F.xxhash64("rep", F.lit("audit")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / total))
    asked = classes.where(part | (F.col("n") == 0)).select("rep", "e").toPandas()
    ids, x = asked["rep"].to_numpy(), _unit(asked["e"]) if len(asked) else np.zeros((0, 1))

    def count(batches):
        sums, low = np.zeros(len(ids), np.int64), x.astype(np.float32)
        for batch in batches:
            if len(batch) and len(ids):
                y, own, n = _vectors(batch["e"]), batch["rep"].to_numpy(), batch["n"].to_numpy()
                for i in range(0, len(y), BLOCK):
                    a, b = np.nonzero(y[i : i + BLOCK].astype(np.float32) @ low.T >= threshold - 1e-3)
                    near = (own[i + a] != ids[b]) & (_dots(y, i + a, x, b) >= threshold)
                    np.add.at(sums, b[near], n[i + a[near]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], ["rep", "true"])

    counted = classes.select("rep", "e", "n").mapInArrow(count, "rep long, true long")
    return cut(counted.groupBy("rep").agg(F.sum("true").alias("true")).where(F.col("true") > 0))


def recall_of(known: DataFrame, found: DataFrame) -> float:
    """Of the audited classes that link with anything: the lesser of links found over links there are and of its mean over the classes."""
    hit = F.least(F.coalesce("links", F.lit(0)), F.col("true"))
    r = known.join(found, "rep", "left").agg(F.count("*"), F.sum("true"), F.sum(hit), F.avg(hit / F.col("true"))).first()
    return min(r[2] / r[1], r[3]) if r[0] else 1.0


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall), one row per row of vectors (vec_id, embedding).

    Null, empty and zero vectors, those with a null or non-finite component, and rows with a null vec_id link with nothing;
    vectors of different lengths don't link with each other. Equal vectors are linked; rows repeated as a whole count once
    as partners. Components of type float stay so, others are doubles; cosines are doubles. recall is the least that the audit
    found for any length of vectors, 1 where all were compared. An empty table gives an empty result; other columns are ignored.
    """
    e = F.col("embedding")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    e = e.cast(kind)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    valid = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda v: v != 0)
    keyed = vectors.select("vec_id", F.when(valid, e).alias("e"))
    keyed = keyed.select("vec_id", "e", F.when(F.col("e").isNotNull(), F.xxhash64("e", F.lit(1))).alias("h"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(2), "e")).alias("g"))
    rows, key = cut(keyed.select("vec_id", "h", "g")), ["h", "g"]  # 128 bits stand for a vector, which is moved once
    count = rows.where("h is not null").distinct().groupBy(*key).agg(F.count("*").alias("n"))
    classes = cut(keyed.where("h is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.first("e").alias("e")).join(count, key))
    parts, recall, span = [], 1.0, classes.agg(F.min("rep"), F.max("rep")).first()
    for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect():
        own = classes.where(F.size("e") == r.d).select("rep", "e", "n")
        every = cut(own.unionByName(plant(own, r.n, threshold, *span)))
        known = truth(every, threshold, AUDIT_ROWS, r.n)
        for k in range(ROUNDS):
            found = cut(_linked(every, r.n, threshold, MARGIN * min(2**k, 2), BEAM * 4**k, shard_rows))
            reached = recall_of(known, found.groupBy("rep").agg(F.sum("links").alias("links")))
            if reached >= RECALL:
                recall = min(recall, reached)
                break
        else:
            found = cut(_linked(own, r.n, threshold, math.inf, None, shard_rows))
        parts.append(found)
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(recall).alias("recall"))
    found = parts[0]
    for one in parts[1:]:
        found = found.unionByName(one)
    group = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select(*key, "rep", "n").join(sums, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = cut(of_class.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(of_class, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("recall", F.lit(recall))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
