"""Integrity checks that a store without constraints needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.operators.lineage import cut


def fk_violations(tables: dict[str, DataFrame], keys: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column, parent, violations): non-null child values without a parent, one row per key, zeros included."""
    out = None
    for child, column, parent, key in keys:
        own = tables[child].where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
        lost = own.join(tables[parent].select(F.col(key).alias("k")), "k", "left_anti")
        row = lost.agg(F.count("*").alias("violations")).select(F.lit(child).alias("child"), F.lit(column).alias("column_name"), F.lit(parent).alias("parent"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def domain_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, violations): one scan counts the rows that fail each check; null counts as passed, as in SQL."""
    counts = df.agg(*(F.count_if(~c).alias(name) for name, c in checks.items()))
    return counts.unpivot([], list(checks), "check_name", "violations")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that only one of two snapshots has, copies counted, with their side."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, keys: Iterable[tuple[str, str, str, str]], root: str = "symbol", key: str = "id") -> dict[str, DataFrame]:
    """All tables without the given root ids and the rows that depend on them at any depth.

    A table is looked at again whenever one that it depends on has lost rows; keys that form a cycle must end by the data.
    """
    keys, out = list(keys), dict(tables)
    lost = [(root, key, gone.select(F.col(key).alias("__key")).distinct())]
    out[root] = out[root].join(lost[0][2], out[root][key] == F.col("__key"), "left_anti")
    while lost:
        parent, column, ids = lost.pop(0)
        for child, child_column, of, parent_key in keys:
            if of != parent or child not in out or parent_key != column:
                continue
            doomed = cut(out[child].join(ids, F.col(child_column) == F.col("__key"), "left_semi"))
            if doomed.isEmpty():
                continue
            out[child] = cut(out[child].join(ids, F.col(child_column) == F.col("__key"), "left_anti"))
            lost += [(child, k, doomed.select(F.col(k).alias("__key")).distinct()) for k in sorted({parent_key for _, _, of, parent_key in keys if of == child})]
    return out


def schema_differences(spark: SparkSession, tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """(table_name, column_name, problem): tables, and columns of those that are there, which are missing or unexpected."""
    rows = [(name, "", "missing") for name in wanted if name not in tables] + [(name, "", "unexpected") for name in tables if name not in wanted]
    for name in tables.keys() & wanted.keys():
        rows += [(name, c, "missing") for c in wanted[name] if c not in tables[name].columns] + [(name, c, "unexpected") for c in tables[name].columns if c not in wanted[name]]
    return spark.createDataFrame(rows, "table_name string, column_name string, problem string")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """What of inner is not in outer."""
    return inner.distinct().join(outer.distinct(), inner.columns, "left_anti")
