"""Joins between facts: edge resolution, look-ups, ownership by longest prefix, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.functions import paths
from factfold.functions.ids import pack_id
from factfold.operators.allocate import numbered_rows


def resolve_edges(edges: DataFrame, symbols: DataFrame, src: str, dst: str, key: str, name: str, how: str = "inner") -> DataFrame:
    """edges with source_name and target_name; with how="left" unresolved ends have none. Catalyst picks the join by size."""
    left = symbols.select(F.col(key).alias(src), F.col(name).alias("source_name"))
    right = symbols.select(F.col(key).alias(dst), F.col(name).alias("target_name"))
    return edges.join(left, src, how).join(right, dst, how)


def dangling(edges: DataFrame, symbols: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges with an end that is no symbol, and which end."""
    ids = symbols.select(F.col(key).alias("__id")).distinct()
    missing = lambda c: edges.join(ids, edges[c] == ids["__id"], "left_anti").withColumn("missing", F.lit(c))
    return missing(src).unionByName(missing(dst))


def lookup_or_insert(wanted: DataFrame, symbols: DataFrame, file: int) -> DataFrame:
    """symbols (id, usr, is_external, line, col, offset) with a placeholder for each usr wanted that has none.

    Placeholders are external, have no place and get the next ids of the given file in the order of their usr.
    """
    fresh = wanted.select("usr").where("usr is not null and usr <> ''").distinct().join(symbols.select("usr"), "usr", "left_anti")
    numbered = numbered_rows(fresh, ["usr"], "__n").withColumn("__file", F.lit(file).cast("long"))
    used = symbols.where(F.shiftrightunsigned("id", 32) == file).agg((F.coalesce(F.max(F.col("id").bitwiseAND(F.lit((1 << 32) - 1))), F.lit(-1)) + 1).alias("__next"))
    zero = F.lit(0)
    added = numbered.crossJoin(F.broadcast(used)).select(pack_id(F.col("__file"), F.col("__next") + F.col("__n")).alias("id"), "usr", F.lit(1).alias("is_external"), zero.alias("line"), zero.alias("col"), zero.alias("offset"))
    return symbols.select(added.columns).unionByName(added)


def lookup_or_fail(rows: DataFrame, owners: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose owner exists, the others with an error)."""
    errors = rows.join(owners.select(on), on, "left_anti").withColumn("error", F.format_string("no owner: %s", F.col(on).cast("string")))
    return rows.join(owners.select(on).distinct(), on, "left_semi"), errors


def longest_prefix_owner(files: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """files with the root that owns each: the longest that is the path itself or an ancestor directory of it, else null.

    Each path is exploded into its few prefixes and these are joined by equality, so the work grows with the paths and not
    with paths times roots.
    """
    keyed = files.select(F.col(path)).distinct().select(path, F.explode(paths.prefixes(F.col(path))).alias("__prefix"))
    found = keyed.join(roots.select(F.col(root).alias("__prefix")).distinct(), "__prefix").groupBy(path).agg(F.max_by("__prefix", F.length("__prefix")).alias("owner"))
    return files.join(found, path, "left")


def preferred(first: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Two tables of names merged, the first one's values winning."""
    a, b = first.select(key, F.col(value).alias("__a")), other.select(key, F.col(value).alias("__b"))
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(value))


def references(declarations: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Each use with its declaration; uses without one are left out."""
    return uses.join(declarations, key)


def has_role(roles: Column, role_bits: int) -> Column:
    return roles.bitwiseAND(F.lit(role_bits)) != 0


def deterministic_winner(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row of the smallest order, and how many others there were."""
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__w"), (F.count("*") - 1).alias("duplicates"))
    return won.select(*keys, *(F.col("__w")[c].alias(c) for c in rest), "duplicates")


def newest_version(components: DataFrame, name: str, path: str) -> DataFrame:
    """(name, root): of components of one name below one base the root of the highest version; none if the bases differ."""
    parts = components.select(name, path, paths.split_version(F.col(path)).alias("v")).select(name, path, "v.base", paths.version_key(F.coalesce("v.version", F.lit("0"))).alias("key"))
    best = parts.groupBy(name).agg(F.max_by(path, F.struct("key", path)).alias("root"), F.min("base").alias("lo"), F.max("base").alias("hi"))
    return best.where("lo = hi").select(name, "root")
