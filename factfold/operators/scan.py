"""Prefix scans over ranges: what came before a row in its group, without a window over the whole group.

Rows are dealt to ranges of (group, order) and written once. Within a range a window gives the prefix; a group that spans ranges has one
summary row per range, and the summaries of earlier ranges are carried into later ones. Only the first group of a range can have
come from before, so there are no more carries than ranges, and these are broadcast; the largest task is a range, however hot a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfold.operators.lineage import cut


def _scan(rows: DataFrame, group: str, order: list[str], of: Column, name: str, add, join, ranges: int | None = None) -> DataFrame:
    """rows with ``name``: ``add`` over ``of`` of the rows before in the group (null for the first); ``join`` puts two such together."""
    ranged = cut(rows.repartitionByRange(*([ranges] if ranges else []), F.col(group), *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("__within", add(of).over(before))
    sums = ranged.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__at")).agg(add(of).alias("__sum"))
    earlier = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("__carry", add(F.col("__sum")).over(earlier)).where("__carry is not null").drop("__sum")
    joined = within.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__at")), "left")
    return joined.select(*rows.columns, join(F.col("__carry"), F.col("__within")).alias(name))


def running_max(rows: DataFrame, group: str, order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the greatest ``value`` of the rows before in their group; null for the first and where all before are null."""
    return _scan(rows, group, order, F.col(value), name, F.max, lambda a, b: F.greatest(a, b), ranges)


def running_sum(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of ``value`` of the rows before in their group, 0 for the first."""
    return _scan(rows, group, order, F.col(value).cast("long"), name, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def open_regions(events: DataFrame, file: str, order: str, kind: str, enter: str = "enter", leave: str = "leave", rounds: int = 40) -> DataFrame:
    """events with depth and stack: the places (order) of the regions that are open at each event, outermost first.

    Events of a file have different whole numbers as order. A region is open from after its enter event up to its leave event, which
    counts as inside; a leave event without a region is ignored. The depth is a running sum. The region around an event is the last one
    entered at the event's depth, which is a running maximum within (file, depth); so every region has its parent, and stacks are
    joined up by doubling: rounds are the binary digits of the depth.
    """
    step = F.when(F.col(kind) == enter, 1).when(F.col(kind) == leave, -1).otherwise(0)
    summed = running_sum(events.withColumn("__step", step), file, [order], "__step", "__sum")
    low = running_max(summed.withColumn("__fall", -(F.col("__sum") + F.least(F.col("__step"), F.lit(0)))), file, [order], "__fall", "__low")
    # leaves beyond the beginning lower the sum; the depth counts from the lowest sum so far
    floor = F.greatest(F.coalesce("__low", F.lit(0)), F.lit(0))
    at = low.withColumn("depth", (F.col("__sum") + floor).cast("long")).drop("__sum", "__step", "__fall", "__low")
    level = F.when(F.col(kind) == enter, F.col("depth") + 1)
    asks = at.select(F.col(file).alias("__file"), F.col(order).alias("__order"), F.col("depth").alias("__level"), F.lit(None).cast("long").alias("__open"))
    opens = at.where(level.isNotNull()).select(F.col(file), F.col(order), level, F.col(order).cast("long"))
    keyed = asks.unionByName(opens.toDF("__file", "__order", "__level", "__open")).withColumn("__key", F.struct("__file", "__level")).withColumn("__ask", F.col("__open").isNull())
    around = running_max(keyed, "__key", ["__order", "__ask"], "__open", "__parent").where("__ask").select("__file", "__order", F.when(F.col("__level") > 0, F.col("__parent")).alias("__parent"))
    placed = cut(at.join(around, (F.col(file) == F.col("__file")) & (F.col(order) == F.col("__order"))).drop("__file", "__order"))
    state = cut(placed.where(F.col(kind) == enter).select(F.col(file).alias("__file"), F.col(order).cast("long").alias("__node"), F.col("__parent").alias("__up"), F.array(F.col(order).cast("long")).alias("__path")))
    for _ in range(rounds):
        if state.where("__up is not null").isEmpty():
            break
        above = state.select(F.col("__file").alias("__f"), F.col("__node").alias("__n"), F.col("__up").alias("__u"), F.col("__path").alias("__p"))
        joined = state.join(above, (F.col("__file") == F.col("__f")) & (F.col("__up") == F.col("__n")), "left")
        state = cut(joined.select("__file", "__node", F.col("__u").alias("__up"), F.concat(F.coalesce("__p", F.array().cast("array<bigint>")), "__path").alias("__path")))
    else:
        raise RuntimeError(f"stacks are deeper than 2 ** {rounds}")
    own = state.select("__file", F.col("__node").alias("__up"), "__path")
    out = placed.join(own, (F.col(file) == F.col("__file")) & (F.col("__parent") == F.col("__up")), "left")
    return out.select(*events.columns, "depth", F.coalesce("__path", F.array().cast("array<bigint>")).alias("stack"))
