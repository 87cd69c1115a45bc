"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers, and equal ones become one row with its multiplicity. Lloyd's rounds run over these distinct
rows: each task assigns its own to the nearest of the few centroids and gives weighted integer sums, which are added up by
cluster and component; only those totals (clusters times components) come to the driver, where the new centroids are their exact floors.
The last assignment is joined back to the vectors' ids. Everything is integer arithmetic, so neither the order of rows nor
a task that runs again changes anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import cut, read

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED, BLOCK = 40, 5, 64, 256, "2", 8_192
#: A vector that more than one in HEAVY rows share is joined by broadcast; there are fewer than HEAVY such.
HEAVY = 1_000
#: Components from this on would not survive floor(SCALE * x) as longs.
HUGE = float(1 << 54)


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the rows whose embedding has exactly ``dimensions`` components, none of them null or non-finite."""
    e = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = vectors.select("vec_id", e.alias("e")).where((F.size("e") == dimensions) & ~F.exists("e", bad))
    whole = lambda v: F.when(F.abs(v) < HUGE, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return kept.select("vec_id", F.transform("e", whole).alias("q"))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smallest of equals) and the squared distance to it, exactly."""
    top = max(abs(int(a)) for v in (x, c) for a in (v.min(initial=0), v.max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else object  # whole doubles up to 2 ** 53 are exact in any order of sums
    at, out = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    c = c.astype(kind)
    for i in range(0, len(x), BLOCK):
        own = x[i : i + BLOCK].astype(kind)
        d = (own * own).sum(axis=1)[:, None] - 2 * own.dot(c.T) + (c * c).sum(axis=1)[None, :]
        k = d.argmin(axis=1)
        at[i : i + BLOCK], out[i : i + BLOCK] = k, d[np.arange(len(own)), k]
    return at, out


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimensions)


def totals(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster how many vectors it has and the sums of their components."""
    size, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(size, object), np.zeros((size, dimensions), object)
        for batch in batches:
            x, m = _matrix(batch.column(0), dimensions), batch.column(1).to_numpy()
            at, _ = nearest(x, centroids)
            kind = np.int64 if float(np.abs(x).max(initial=0)) * float(m.sum()) < 1 << 62 else object
            part, rows = np.zeros((size, dimensions), kind), np.zeros(size, np.int64)
            np.add.at(part, at, x.astype(kind) * m.astype(kind)[:, None])
            np.add.at(rows, at, m)
            count, sums = count + rows.astype(object), sums + part.astype(object)
        k = np.flatnonzero(count)
        if len(k):
            whole = pa.array([Decimal(int(v)) for v in sums[k].ravel()], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(np.repeat(k, dimensions), pa.int32()), pa.array(np.tile(np.arange(dimensions), len(k)), pa.int32()), pa.array([int(v) for v in np.repeat(count[k], dimensions)], pa.int64()), whole], ["cluster", "i", "n", "total"])

    parts = distinct.select("q", "m").mapInArrow(run, "cluster int, i int, n long, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out.setdefault(r.cluster, (r.n, [0] * dimensions))[1][r.i] = int(r.total)
    return out


def moved(centroids: np.ndarray, found: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean, those without vectors where they were."""
    return np.array([[s // found[k][0] for s in found[k][1]] if k in found else own.tolist() for k, own in enumerate(centroids)], np.int64)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(h, g, m, cluster, distance) of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = nearest(_matrix(batch.column(3), centroids.shape[1]), centroids)
                yield pa.record_batch([*batch.columns[:3], pa.array(at), pa.array(d)], ["h", "g", "m", "cluster", "distance"])

    return distinct.select("h", "g", "m", "q").mapInArrow(run, "h long, g long, m long, cluster int, distance long")


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed:vec_id``, in this order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.q for r in rows.select("q", order.alias("order")).orderBy("order", "q").limit(clusters).collect()], np.int64)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept row of vectors (vec_id, embedding).

    Vectors that are null, of another length or hold null or non-finite components have no row. Fewer kept rows than ``clusters``
    make as many centroids as there are; repeated rows, and those without a vec_id (hashed as an empty one), count like any other.
    Other columns are ignored; an empty table gives an empty result. Components of 2 ** 54 and more, and distances or sums of them
    beyond a long, raise.
    """
    rows = quantised(vectors, dimensions)
    keyed = rows.select("vec_id", "q", F.xxhash64("q").alias("h"), F.xxhash64(F.lit(1), "q").alias("g"))  # 128 bits stand for a vector
    narrow = cut(keyed.select("vec_id", "h", "g"))
    total = narrow.count()
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not total:
        kinds = ("int", "long", "long", "long", "string")
        return narrow.select("vec_id", *(F.lit(None).cast(k).alias(c) for c, k in zip(columns[1:], kinds, strict=True)))
    distinct = cut(keyed.groupBy("q").agg(F.count("*").alias("m")).select("q", "m", F.xxhash64("q").alias("h"), F.xxhash64(F.lit(1), "q").alias("g")))
    centroids = first_centroids(rows, clusters, seed)
    for _ in range(rounds):
        centroids = moved(centroids, totals(distinct, centroids))
    found = cut(assigned(distinct, centroids))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("m")).cast("long").alias("s")).collect()  # a row per cluster
    own, digest = {r.cluster: r.s for r in sums}, [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = [(k, own[k], sum(own.values()), digest[k]) for k in own]
    facts = F.broadcast(vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    heavy = found.where(F.col("m") * HEAVY > total)
    light = narrow.join(F.broadcast(heavy.select("h", "g")), ["h", "g"], "left_anti").join(found.where(F.col("m") * HEAVY <= total), ["h", "g"])
    both = light.unionByName(narrow.join(F.broadcast(heavy), ["h", "g"]), allowMissingColumns=True)
    return both.join(facts, "cluster").select(*columns)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> str:
    near = "SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, sum((x - y) * (x - y)) AS d FROM q JOIN c{0} USING (i) GROUP BY ALL) GROUP BY r"
    step = "a{0} AS MATERIALIZED (" + near + "), c{1} AS MATERIALIZED (SELECT k, i, coalesce(mean, y) AS y FROM c{0} LEFT JOIN (SELECT k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean FROM q JOIN a{0} USING (r) GROUP BY ALL) USING (k, i))"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, generate_subscripts(e, 1) AS i, floor({scale} * unnest(e)::DOUBLE)::BIGINT AS x FROM v),
c0 AS MATERIALIZED (SELECT k, i, x AS y FROM (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM v) JOIN q USING (r) WHERE k < {clusters}),
{", ".join(step.format(k, k + 1) for k in range(rounds))},
f AS MATERIALIZED ({near.format(rounds)}), s AS (SELECT k, sha256(string_agg(y, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM v JOIN f USING (r) JOIN s USING (k)"""


OP13_SQL = _sql()
