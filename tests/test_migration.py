"""Older fact tables, and upserts of projects and files, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factfold import schema
from factfold.plans import migration
from factfold.plans.registry import RegistryError


def test_tables_that_a_store_lacks_are_empty_and_present_rows_stay(spark):
    now = spark.createDataFrame([(1, 0, "x", 7, 1, 2, 3, 4, 5, 1, 0, 0, 1, 0, 1, 1)], schema.FACTS["parameter"])
    once = migration.migrate(spark, {"parameter": now})
    assert list(once) == list(schema.FACTS) and once["enumerator"].count() == 0
    assert once["parameter"].collect() == now.collect() == migration.migrate(spark, once)["parameter"].collect()
    assert all(once[name].columns == schema.empty(spark, name).columns for name in schema.FACTS)


def test_every_bit_unfolds_by_itself(spark):
    for table in ("template_argument", "template_parameter", "relation"):
        bits = migration.PACKED_BITS[table]
        rest = [c for c in schema.empty(spark, table).schema if c.name not in bits and c.name not in migration.PACKED_FIELDS.get(table, {})]
        rows = spark.range(7).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in rest), F.when(F.col("id") < 6, F.pow(F.lit(2), "id")).cast("int").alias("flags"), "id")
        got = migration.migrate_table(table, rows.orderBy("id")).collect()
        for k, row in enumerate(got):
            assert {c for c in bits if row[c]} == {c for c, place in bits.items() if place == k}
        if table == "relation":
            assert [r.access for r in got] == ["protected", "private", "public", "public", "public", "public", "none"]


def test_columns_of_later_versions_and_missing_ones(spark):
    columns = [c for c in schema.empty(spark, "symbol").schema if c.name != "has_extern_storage"]
    rows = spark.range(2).select(*(F.lit("1").cast(c.dataType).alias(c.name) for c in columns), F.lit(1).alias("file_id"))
    got = migration.migrate_table("symbol", rows).collect()
    assert [(r.has_extern_storage, r.is_final, "file_id" in r.asDict()) for r in got] == [(0, 1, False)] * 2
    with pytest.raises(RegistryError, match="identity"):
        migration.migrate_table("symbol", rows.drop("identity"))


def test_files_are_upserted_once(spark):
    stored = {"directory": spark.createDataFrame([(4, 1, "a")], "id long, component_id long, path string"), "file": spark.createDataFrame([(9, 4, "x")], "id long, directory_id long, name string")}
    found = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (2, "a", "x"), (1, None, "z"), (None, "a", "z"), (2, "", "x")], "component_id long, directory string, name string")
    after = migration.upsert_files(stored, found)
    assert sorted(map(tuple, after["directory"].collect())) == [(4, 1, "a"), (5, 2, ""), (6, 2, "a")]
    assert sorted(map(tuple, after["file"].collect())) == [(9, 4, "x"), (10, 4, "y"), (11, 5, "x"), (12, 6, "x")]
    again = migration.upsert_files(after, found)
    assert all(sorted(map(tuple, again[k].collect())) == sorted(map(tuple, after[k].collect())) for k in after)


def test_projects_keep_their_clones(spark):
    stored = {
        "repository": spark.createDataFrame([(1, "r", "old", 5)], "id long, name string, remote_url string, active_clone_id long"),
        "clone": spark.createDataFrame([(5, 1, "/p", "a")], "id long, repository_id long, path string, label string"),
    }
    projects = spark.createDataFrame([("r", "new", "/q", "b"), ("s", None, "/p", "c")], "name string, remote_url string, path string, label string")
    after = migration.upsert_projects(stored, projects)
    assert sorted(tuple(r[c] for c in ("id", "repository_id", "path", "label")) for r in after["clone"].collect()) == [(5, 1, "/p", "c"), (6, 1, "/q", "b")]
    assert sorted((r.id, r.name, r.remote_url, r.active_clone_id) for r in after["repository"].collect()) == [(1, "r", "new", 6), (2, "s", None, 5)]
    with pytest.raises(RegistryError):
        migration.upsert_projects(stored, projects.withColumn("name", F.lit("")))
