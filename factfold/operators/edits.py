"""Text edits and lint findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.operators.lineage import cut
from factfold.operators.scan import running_max


def deduplicate(edits: DataFrame) -> DataFrame:
    """The same edit found in several translation units counts once."""
    return edits.dropDuplicates(["file", "offset", "length", "text"])


def overlaps(edits: DataFrame) -> DataFrame:
    """edits with rejected = 1 where one begins before an earlier one of its file ends; insertions at one place may follow. A file of any
    number of edits is spread over ranges of its offsets."""
    known = running_max(edits.withColumn("__end", F.col("offset") + F.col("length")), "file", ["offset", "length", "text"], "__end", "__before")
    return known.withColumn("rejected", F.coalesce((F.col("offset") < F.col("__before")).cast("int"), F.lit(0))).drop("__end", "__before")


def commit_groups(edits: DataFrame, group: str) -> DataFrame:
    """The edits of groups none of whose edits is rejected."""
    bad = overlaps(edits).where("rejected = 1").select(group).distinct()
    return edits.join(bad, group, "left_anti")


def apply_edits(text: Column, edits: Column) -> Column:
    """text with edits (offset, length, text) in characters of the original; they must not overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda s, e: F.struct(F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), (e["offset"] - s["at"]).cast("int")), e["text"]).alias("out"), (e["offset"] + e["length"]).cast("long").alias("at"))
    done = F.aggregate(F.array_sort(edits), start, step)
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))


def rewrite(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (file, text) with their edits applied; overlapping edits are left out and files without edits stay."""
    good = overlaps(deduplicate(edits)).where("rejected = 0")
    lists = good.groupBy("file").agg(F.collect_list(F.struct(F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.col("text").alias("text"))).alias("__edits"))
    return files.join(lists, "file", "left").withColumn("text", F.when(F.col("__edits").isNotNull(), apply_edits(F.col("text"), F.col("__edits"))).otherwise(F.col("text"))).drop("__edits")


def findings_once(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["file", "offset", "check"])


def null_literals(tokens: DataFrame) -> DataFrame:
    """Edits that replace null constants, from tokens (file, spelling, offset)."""
    return tokens.where(F.col("spelling").isin("NULL", "__null")).select("file", "offset", F.length("spelling").alias("length"), F.lit("nullptr").alias("text"))


def missing_override(methods: DataFrame) -> DataFrame:
    """Methods that override, say so nowhere and have a body."""
    return methods.where("overrides = 1 and is_override = 0 and has_body = 1")


def too_many(rows: DataFrame, owner: str, most: int = 4) -> DataFrame:
    """Owners of more rows than ``most``, with their number."""
    return rows.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") > most)


def with_and_without(owners: DataFrame, having: DataFrame, lacking: DataFrame, on: str) -> DataFrame:
    """Owners that have a row in one table and none in the other."""
    return owners.join(having.select(on), on, "left_semi").join(lacking.select(on), on, "left_anti")


def missing_cases(owners: DataFrame, handled: DataFrame, owner: str, case: str, block: int = 4_096) -> DataFrame:
    """(owner, case) for each owner and each case that any owner handles and it doesn't; null cases are none. The cases, however many,
    stand in blocks of about ``block``, and an owner meets each block once."""
    cases = cut(handled.select(case).where(F.col(case).isNotNull()).distinct())
    blocks = -(-cases.count() // block)
    dealt = cases.groupBy(F.pmod(F.xxhash64(case), F.lit(max(blocks, 1))).cast("int").alias("__block")).agg(F.collect_list(case).alias("__cases"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1)) if blocks else F.array().cast("array<int>")
    wanted = owners.select(owner, F.explode(every).alias("__block")).join(dealt, "__block").select(owner, F.explode("__cases").alias(case))
    return wanted.join(handled, [owner, case], "left_anti")
