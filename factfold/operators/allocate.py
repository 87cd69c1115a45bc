"""Dense indices within a file, continued across runs.

Numbering is by an explicit sequence: rows are dealt to ranges of it, and each range goes on from the counts of those before it, so
that neither a hot file nor the whole table is one task's. Numbers of rows that are stored already are never touched, so a rerun
gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.functions.ids import pack_id
from factfold.operators.lineage import cut


def numbered_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 on in the given order; equal rows of it are numbered in any order."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))  # one row per range
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = ranged.withColumn(name, within.cast("long")).join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return placed.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def sequence(rows: DataFrame, file: str, order: list[str], name: str = "index") -> DataFrame:
    numbered = numbered_rows(rows, [file, *order], "__all")
    first = numbered.groupBy(F.col(file).alias("__file")).agg(F.min("__all").alias("__first"))
    return numbered.join(first, F.col(file).eqNullSafe(F.col("__file"))).select(*rows.columns, (F.col("__all") - F.col("__first")).alias(name))


def next_index(rows: DataFrame, file: str, index: str) -> DataFrame:
    """The allocator's state: one more than the largest index of each file."""
    return rows.groupBy(file).agg((F.max(index) + 1).cast("long").alias("next_index"))


def allocate(stored: DataFrame, new: DataFrame, file: str, key: str, order: list[str]) -> DataFrame:
    """(file, key, index, id) of all keys: stored ones as they are, new ones from their file's next index on."""
    fresh = new.join(stored.select(key), key, "left_anti")
    numbered = sequence(fresh, file, order, "__n").join(next_index(stored, file, "index"), file, "left")
    added = numbered.select(file, key, (F.coalesce("next_index", F.lit(0)) + F.col("__n")).alias("index"))
    every = stored.select(file, key, "index").unionByName(added)
    return every.withColumn("id", pack_id(F.col(file), F.col("index")))


def density(rows: DataFrame, file: str, index: str) -> DataFrame:
    """By file: rows, next index and whether the indices are exactly 0 to n - 1."""
    stats = rows.groupBy(file).agg(F.count("*").alias("n"), F.count_distinct(index).alias("kinds"), F.min(index).alias("least"), (F.max(index) + 1).alias("next_index"))
    return stats.select(file, "n", F.col("next_index").cast("long").alias("next_index"), ((F.col("least") == 0) & (F.col("next_index") == F.col("n")) & (F.col("kinds") == F.col("n"))).cast("int").alias("is_dense"))
