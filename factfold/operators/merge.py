"""Merging repeated sightings by a declared rule per column.

Sightings carry an explicit sequence; one aggregation with map-side combine gives the merged row, whatever the order in which
rows arrive. Incremental merges union the stored rows in front of the new ones and merge again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules of the symbol table: flags are sticky, externality must hold at every sighting, places stay where first seen.
SYMBOL_RULES = {
    "identity": "first", "line": "first", "col": "first", "offset": "first", "node": "last", "kind": "last", "sub_kind": "last", "lang": "last",
    "properties": "last", "usr": "last", "qualified_name": "last", "access": "last_but:none", "ref_qualifier": "last_but:none",
    "constant_evaluation": "last_but:none", "is_external": "and", "is_definition": "or", "is_static": "or", "is_virtual": "or", "is_const": "or",
    "is_inline": "or", "is_override": "or", "is_deleted": "or", "is_defaulted": "or", "has_extern_storage": "or", "has_internal_linkage": "or",
}


def rule(column: str, how: str, seq: Column) -> Column:
    """``or`` and ``and`` of 0/1 columns, ``first`` and ``last`` by sequence, ``last_but:x`` the last that isn't x, ``count``, ``sum``."""
    c = F.col(column)
    if how == "or":
        return F.max(c).alias(column)
    if how == "and":
        return F.min(c).alias(column)
    if how == "first":
        return F.min_by(c, seq).alias(column)
    if how == "last":
        return F.max_by(c, seq).alias(column)
    if how == "count":
        return F.count(F.lit(1)).alias(column)
    if how == "sum":
        return F.sum(c).alias(column)
    if how.startswith("last_but:"):
        unset = how.partition(":")[2]
        return F.coalesce(F.max_by(F.when(c != unset, c), F.when(c != unset, seq)), F.lit(unset)).alias(column)
    raise ValueError(f"unknown merge rule {how!r}")


def merge(sightings: DataFrame, keys: list[str], rules: Mapping[str, str], seq: list[str]) -> DataFrame:
    """One row per key; seq names the columns that order sightings and must not tie within a key."""
    order = F.struct(*seq)
    return sightings.groupBy(*keys).agg(*(rule(c, how, order) for c, how in rules.items()))


def merge_into(stored: DataFrame, new: DataFrame, keys: list[str], rules: Mapping[str, str], seq: list[str]) -> DataFrame:
    """stored rows count as earlier than all new ones; merging the same rows again changes nothing."""
    columns = [*keys, *rules]
    first = stored.select(*columns, F.lit(0).alias("__batch"), *(F.lit(None).cast(new.schema[s].dataType).alias(f"__{s}") for s in seq))
    then = new.select(*columns, F.lit(1).alias("__batch"), *(F.col(s).alias(f"__{s}") for s in seq))
    return merge(first.unionByName(then), keys, rules, ["__batch", *(f"__{s}" for s in seq)])


_ORDERED = ("first", "last", "last_but:")


def merge_state(sightings: DataFrame, keys: list[str], rules: Mapping[str, str], seq: list[str]) -> DataFrame:
    """What is kept of sightings so that merging goes on later: one row per key, in which the columns of rules that ask for an order are
    (seq, value) pairs. States of any sightings add up in any order, by ``merge_states``."""
    order = F.struct(*seq)

    def part(c: str, how: str) -> Column:
        if not how.startswith(_ORDERED):
            return rule(c, how, order)
        unset = how.partition(":")[2]
        counts = F.lit(True) if not unset else F.col(c) != unset
        pair = F.when(counts, F.struct(order.alias("seq"), F.col(c).alias("value")))
        by = F.when(counts, order)
        return (F.min_by(pair, by) if how == "first" else F.max_by(pair, by)).alias(c)

    return sightings.groupBy(*keys).agg(*(part(c, how) for c, how in rules.items()))


def merge_states(states: DataFrame, keys: list[str], rules: Mapping[str, str]) -> DataFrame:
    """One state per key of states of several parts."""

    def part(c: str, how: str) -> Column:
        if not how.startswith(_ORDERED):
            return rule(c, {"count": "sum"}.get(how, how), F.lit(0))
        return (F.min_by(c, F.col(c)["seq"]) if how == "first" else F.max_by(c, F.col(c)["seq"])).alias(c)

    return states.groupBy(*keys).agg(*(part(c, how) for c, how in rules.items()))


def settled(states: DataFrame, keys: list[str], rules: Mapping[str, str]) -> DataFrame:
    """The merged rows that states, one per key, stand for: those that ``merge`` gives for all their sightings."""
    value = lambda c, how: F.coalesce(F.col(c)["value"], F.lit(how.partition(":")[2])) if how.startswith("last_but:") else F.col(c)["value"]
    return states.select(*keys, *((value(c, how) if how.startswith(_ORDERED) else F.col(c)).alias(c) for c, how in rules.items()))


def insert_ignore(rows: DataFrame, keys: list[str], seq: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The first row of each key that is not stored yet; kept by one aggregation, not by sorting."""
    if stored is not None:
        rows = rows.join(stored.select(*keys), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("__w"))
    return won.select(*(c if c in keys else F.col("__w")[c].alias(c) for c in rows.columns))


def last_wins(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("__w"))
    return won.select(*(c if c in keys else F.col("__w")[c].alias(c) for c in rows.columns))


def replace_parameters(rows: DataFrame, owner: str, position: str, version: str, sticky: str | None = None) -> DataFrame:
    """Ordered lists by owner after all versions: positions beyond the newest version's length go, others have their newest
    row, and the sticky flag stays set once it was."""
    newest = rows.groupBy(owner, version).agg((F.max(position) + 1).alias("n")).groupBy(owner).agg(F.max_by("n", version).alias("arity"))
    last = last_wins(rows, [owner, position], [version])
    if sticky:
        ever = rows.groupBy(owner, position).agg(F.max(sticky).alias(sticky))
        last = last.drop(sticky).join(ever, [owner, position])
    return last.join(newest, owner).where(F.col(position) < F.col("arity")).drop("arity")


def first_sighting(rows: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The row that owns each key: the first by sequence."""
    return insert_ignore(rows, [key], seq)


def with_row_number(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
