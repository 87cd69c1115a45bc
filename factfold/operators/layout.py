"""Layout of records that hold records: level by level of what contains what, so that each record is laid out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.operators.graph import levels
from factfold.operators.lineage import Growing, cut, sized

_FIELD = "struct<position:bigint,size:bigint,align:bigint,bits:bigint>"
_OUT = "array<struct<position:bigint,offset:bigint,size:bigint>>"


def _up(n: Column, step: Column) -> Column:
    return (F.floor((n + step - 1) / step) * step).cast("long")


def _placed(fields: Column, is_union: Column) -> Column:
    """struct(end, align, out) of a record's fields in order."""
    zero, one = F.lit(0).cast("long"), F.lit(8).cast("long")
    start = F.struct(zero.alias("end"), one.alias("align"), F.array().cast(_OUT).alias("out"))

    def step(s: Column, f: Column) -> Column:
        takes = F.coalesce(f["bits"], f["size"])
        room = F.floor(s["end"] / f["size"]) == F.floor((s["end"] + f["bits"] - 1) / f["size"])
        at = F.when(is_union, zero).when((f["bits"] > 0) & room, s["end"]).otherwise(_up(s["end"], f["align"]))
        end = F.when(is_union, F.greatest(s["end"], takes)).otherwise(at + takes)
        align = F.when(f["bits"] == 0, s["align"]).otherwise(F.greatest(s["align"], f["align"]))
        return F.struct(end.alias("end"), align.alias("align"), F.array_append(s["out"], F.struct(f["position"].alias("position"), at.alias("offset"), takes.alias("size"))).alias("out"))

    return F.aggregate(fields, start, step)


def composed_layout(records: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields with offset and size, records with size and alignment), all in bits.

    records (record, is_union); fields (record, position, type, size, align, bits): type names the record that the field holds (bases are
    fields of the first positions) and is null for others, which give their own size and align; bits is the width of a bit-field, else
    null. A field starts at the next multiple of its alignment; a bit-field goes on in the unit of its type where it fits, and one of
    no width only ends the unit. Fields of a union start at 0. A record's size is a multiple of its alignment and 8 at least.

    Each round lays out the records of a level, which hold records of earlier levels only. Records that hold an unknown record, or one that does,
    have no layout; records that hold themselves raise.
    """
    holds = fields.where("type is not null").select(F.col("type").alias("src"), F.col("record").alias("dst")).distinct()
    level = cut(levels(holds))
    placed = sized(level.withColumnRenamed("node", "record"))
    leveled = lambda df: df.join(placed, "record", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    by_level = cut(leveled(fields.select("record", F.col("position").cast("long").alias("position"), "type", *(F.col(c).cast("long").alias(c) for c in ("size", "align", "bits")))), by="level")
    heads = cut(leveled(records.select("record", "is_union").distinct()), by="level")
    last = level.agg(F.max("level")).first()[0] or 0
    counts = {r.level: r["count"] for r in by_level.groupBy("level").count().collect()}  # one row per level
    heads_of = {r.level: r["count"] for r in heads.groupBy("level").count().collect()}
    sizes, laid, known = None, None, 0
    for k in range(last + 1):
        mine = by_level.where(F.col("level") == k)
        if sizes is not None:  # records of level 0 hold none
            inner = sizes.rows().select(F.col("record").alias("type"), F.col("size").alias("__size"), F.col("alignment").alias("__align"))
            of = lambda own, held: F.when(F.col("type").isNull(), F.col(own)).otherwise(F.col(held))
            mine = mine.join(sized(inner, known), "type", "left").withColumn("size", of("size", "__size")).withColumn("align", of("align", "__align"))
        item = F.struct("position", "size", "align", "bits").cast(_FIELD)
        lists = mine.groupBy("record").agg(F.array_sort(F.collect_list(item)).alias("__fields"), F.bool_or(F.col("size").isNull() | F.col("align").isNull()).alias("__open"))
        whole = heads.where(F.col("level") == k).join(sized(lists, counts.get(k, 0)), "record", "left").where("__open is null or not __open")
        done = _placed(F.coalesce("__fields", F.array().cast(f"array<{_FIELD}>")), F.coalesce("is_union", F.lit(False)))
        part = cut(whole.select("record", done.alias("r")).select("record", F.greatest(_up(F.col("r.end"), F.col("r.align")), F.lit(8)).alias("size"), F.col("r.align").alias("alignment"), F.col("r.out").alias("out")))
        own = part.select("record", "size", "alignment")
        known += heads_of.get(k, 0)
        if sizes is None:
            sizes, laid = Growing(own), part
        else:
            sizes.add(own)
            laid = laid.unionByName(part)
    return laid.select("record", F.inline("out")), sizes.rows()
