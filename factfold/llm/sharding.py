"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts are one group and stay together, unless the group would fill over half a shard in some dimension; such
a group is split into pieces. Each piece goes to the shard where the weighted dot product of its (bytes, tokens, rows) with
the shard's residual capacity is highest, large pieces first.

Packing sees groups, not rows: one aggregation makes one row per distinct text. Groups over a hundredth of a shard (at most 300
for each shard, which bounds them) are packed first, on the driver, in pieces if they are split. The others are dealt by hash
into cells of about ``cell_rows`` groups, and each cell fills the shards in proportion to the room that the large pieces left.
A join takes the shards back to the rows, so that no task holds the rows of a group, however many they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factfold.llm.common import cut, read

SHARDS, CELL_ROWS, BLOCK_ROWS, OVERHEAD = 40, 2_500, 25_000, 16
DIMENSIONS = ["size", "tokens", "one"]
#: Weights of the dimensions in the dot product. The law is ``bytes``, so bytes lead and the others settle near-ties.
WEIGHTS = np.array([1.0, 0.02, 0.02])


def pack(pieces: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A shard for each piece (rows of three loads) given the room of each shard (rows of three); ties go to the first."""
    scale = np.maximum(room.clip(0).sum(axis=0), 1e-9)
    left, loads = room / scale * len(room), pieces / scale * len(room)
    out = np.zeros(len(pieces), np.int32)
    for i in np.lexsort([np.arange(len(pieces)), -loads.sum(axis=1)]):
        out[i] = shard = int(np.argmax(left @ (loads[i] * WEIGHTS)))
        left[shard] -= loads[i]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the loads and the group key of each row, the row's number, and no text."""
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id()
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.lit(1).cast("long").alias("one"),
        F.when(F.col("text").isNull(), F.xxhash64(row, F.lit("null"))).otherwise(F.xxhash64(text, F.lit(7))).alias("key"), row.alias("row"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs; the law is ``bytes``.

    size is the UTF-8 length of the text plus 16 (null texts: 16 and the crc32 of nothing). Rows with a null text are groups
    of their own; null ids and repeated rows are placed like any other; other columns are ignored; an empty table gives an
    empty result. slot numbers the rows of a shard from 0 without gaps. grown_shard is null under this law.
    """
    rows = cut(measured(docs))
    identity = ["key", "text_crc32", "size"]
    loads = [f"all_{c}" for c in DIMENSIONS]
    summed = [F.sum(c).alias(f"all_{c}") for c in DIMENSIONS]
    groups = cut(rows.groupBy(*identity).agg(*summed))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in loads), F.count("*").alias("groups")).first()
    full = np.array([total[c] / shards for c in loads], float)
    share = lambda of: F.greatest(*(F.col(c) / F.lit(max(f, 1e-9) * of) for c, f in zip(loads, full, strict=True)))
    large = F.broadcast(groups.where(share(0.01) > 1).select(*identity, F.ceil(share(0.5)).cast("int").alias("pieces")))
    heavy = rows.join(large, identity).withColumn("piece", F.pmod(F.xxhash64("row"), "pieces").cast("int")).drop("pieces")
    pieces = heavy.groupBy(*identity, "piece").agg(*summed).orderBy(*identity, "piece").collect()
    room = np.tile(full, (shards, 1))
    weights = np.array([[r[c] for c in loads] for r in pieces], float).reshape(-1, 3)
    where = pack(weights, room)
    np.subtract.at(room, where, weights)
    room = room.clip(0)
    fixed = [(r["key"], r["text_crc32"], r["size"], r["piece"], int(s)) for r, s in zip(pieces, where, strict=True)]
    held = docs.sparkSession.createDataFrame(fixed, "key long, text_crc32 long, size long, piece int, shard int")

    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(identity, ignore_index=True)
        own = cell[loads].to_numpy(float)
        return cell[identity].assign(shard=pack(own, room / np.maximum(room.sum(axis=0), 1e-9) * own.sum(axis=0)))

    cells = max(1, round(total["groups"] / cell_rows))
    cell = F.pmod(F.xxhash64(*identity), F.lit(cells)).alias("cell")
    packed = groups.where(share(0.01) <= 1).select(cell, *identity, *loads).groupBy("cell").applyInPandas(fill, "key long, text_crc32 long, size long, shard int")
    light = rows.join(large.drop("pieces"), identity, "left_anti").join(packed, identity)
    columns = ["doc_id", "size", "text_crc32", "row", "shard"]
    blocks = int(-(-total["all_one"] // (shards * BLOCK_ROWS))) or 1
    placed = heavy.join(F.broadcast(held), [*identity, "piece"]).select(*columns).unionByName(light.select(*columns))
    placed = cut(placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    slots = placed.withColumn("at", at.cast("long")).join(counts.select("shard", "block", before.alias("before")), ["shard", "block"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
