"""Helpers shared by the training-data operators: lineage cuts, bounded joins, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.operators.lineage import cut

#: Most rows of ids that are broadcast after they have been counted; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: The letters that are lower-cased where only A-Z are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have: the stem with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def arrow_map(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``columns``; None and empty batches give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None and out.num_rows:
                yield out

    return df.select(*columns).mapInArrow(run, schema)


def join_ids(rows: DataFrame, ids: DataFrame, how: str, on: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Join wide rows with a narrow table keyed by ``on``.

    The narrow table is cut and counted first. Up to ``limit`` rows it is broadcast, so that texts are not
    shuffled; beyond that both sides are shuffled by the key.
    """
    ids = cut(ids)
    small = ids.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(ids) if small else ids, on, how)


def crc_bucket(column: str, buckets: int):
    """crc32 of a column written as text, modulo ``buckets``; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8")) % buckets


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges: (node, component), component being the smallest node reachable.

    Random contraction: in each round every vertex picks, of itself and its neighbours, the one whose hash of that
    round is smallest, and the edges are rewritten to the picks. A fresh hash order in each round makes the number of
    vertices fall by a constant factor also on long paths. Only nodes that occur in an edge of two different nodes are
    returned. Nothing is gathered on the driver but the test for emptiness.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    picks = []
    for k in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("o")).union(edges.select("b", "a"))
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
        best = both.groupBy("n").agg(F.min(h("o")).alias("m"))
        pick = cut(best.select("n", F.least("m", h("n"))["v"].alias("r")))
        picks.append(pick)
        left, right = (pick.select(F.col("n").alias(c), F.col("r").alias(f"r{c}")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not picks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = picks[-1]
    for pick in reversed(picks[:-1]):
        above = label.select(F.col("n").alias("r"), F.col("r").alias("top"))
        label = pick.join(above, "r", "left").select("n", F.coalesce("top", "r").alias("r"))
    label = cut(label)
    least = label.groupBy("r").agg(F.min("n").alias("component"))
    return label.join(least, "r").select(F.col("n").alias("node"), "component")
