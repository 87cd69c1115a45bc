"""Facts from declaration rows: keys, merge, ids, side tables and edges of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.functions import ids
from factfold.operators.allocate import allocate, sequence
from factfold.operators.merge import SYMBOL_RULES, insert_ignore, merge


def symbols(sightings: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Merged symbols with ids from sightings (file_id, seq, usr, qualified_name, kind, line, col, ...).

    A symbol belongs to the file that first saw it. Rules are those of merge.SYMBOL_RULES for the columns that are there.
    ``stored`` (file_id, key, index) keeps earlier ids.
    """
    ident = ids.identity(F.col("usr"), F.col("qualified_name"), F.col("kind"), F.col("line"), F.col("col"))
    rows = sightings.withColumn("identity", ident)
    rows = rows.withColumn("key", ids.identity_key(F.col("file_id"), F.col("usr"), F.col("identity")))
    rules = {c: how for c, how in SYMBOL_RULES.items() if c in rows.columns} | {"file_id": "first"}
    merged = merge(rows.withColumn("first_seq", F.col("seq")), ["key"], rules | {"first_seq": "first"}, ["seq"])
    if stored is None:
        numbered = sequence(merged, "file_id", ["first_seq", "key"])
        return numbered.withColumn("id", ids.pack_id(F.col("file_id"), F.col("index")))
    named = allocate(stored, merged.select("file_id", "key", "first_seq"), "file_id", "key", ["first_seq", "key"])
    return merged.drop("file_id").join(named, "key")


def edges(rows: DataFrame, symbols_: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Edges (source_key, target_key, kind, position, seq, ...) as relation rows; targets without a symbol are left out, and
    of repeated edges the first stays."""
    own = symbols_.select("key", "id")
    resolved = rows.join(own.select(F.col("key").alias("source_key"), F.col("id").alias("source_id")), "source_key").join(own.select(F.col("key").alias("target_key"), F.col("id").alias("destination_id")), "target_key")
    keys = ["source_id", "destination_id", "kind", "position"]
    return insert_ignore(resolved.drop("source_key", "target_key"), keys, ["seq"], stored).drop("seq")


def lists(rows: DataFrame, owner: str, items: str) -> DataFrame:
    """An array of structs by owner as a side table with positions."""
    return rows.select(owner, F.posexplode(items).alias("position", "item")).select(owner, "position", "item.*")


def nested(side: DataFrame, owner: str) -> DataFrame:
    """A side table with positions back to one ordered array by owner."""
    rest = [c for c in side.columns if c not in (owner, "position")]
    return side.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("items"))


def pack_values(values: DataFrame, owner: str, packs: str) -> DataFrame:
    """Template values, some of them packs (array of arrays), flattened: pack_index counts within a pack and is -1 outside."""
    one = F.transform(packs, lambda p: F.when(F.size(p) == 1, F.transform(p, lambda v: F.struct(v.alias("value"), F.lit(-1).alias("pack_index")))).otherwise(F.transform(p, lambda v, i: F.struct(v.alias("value"), i.alias("pack_index")))))
    return lists(values.select(owner, F.flatten(one).alias("items")), owner, "items")
