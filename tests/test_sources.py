"""Sources that read files, on small files."""

from __future__ import annotations

import sqlite3

from factfold.plans import registry
from factfold.sources import readers


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    at = str(tmp_path / "facts.db")
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE symbol_allocator (file_id INTEGER PRIMARY KEY, next_index INTEGER)")
        db.execute("CREATE TABLE definition (symbol_id INTEGER, file_id INTEGER, offset INTEGER, size INTEGER)")
        db.executemany("INSERT INTO symbol_allocator VALUES (?, ?)", [(i, i * 2) for i in range(3, 200)])
    rows = readers.sqlite(spark, at, "symbol_allocator").collect()
    assert sorted((r.file_id, r.next_index) for r in rows) == [(i, i * 2) for i in range(3, 200)]
    assert readers.sqlite(spark, at, "definition").collect() == []


def test_trees_and_optional_tables(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.h").write_text("int a;")
    (tmp_path / "src" / "deep" / "b.h").write_text("int b;")
    (tmp_path / "src" / "c.txt").write_text("c")
    tree = readers.file_tree(spark, str(tmp_path / "src"), "*.h")
    assert sorted(r.path.rsplit("/", 1)[1] for r in tree.collect()) == ["a.h", "b.h"]
    assert {r["size"] for r in tree.collect()} == {6}
    assert readers.optional_table(spark, "no_such_label", "label").columns == ["name", "path"]


def test_stored_files_are_anchored_below_the_active_clone(spark):
    files = spark.createDataFrame([(1, 1, "x.cc", '["-DA"]', "cc", "/w"), (2, 1, "y.cc", None, None, None)], "id long, directory_id long, name string, compile_options string, driver string, working_directory string")
    directories = spark.createDataFrame([(1, 1, "src")], "id long, component_id long, path string")
    components = spark.createDataFrame([(1, "main", "lib", "1.2", 1)], "id long, name string, path string, version string, repository_id long")
    repositories, clones = spark.createDataFrame([(1, 5)], "id long, active_clone_id long"), spark.createDataFrame([(5, "/clone")], "id long, path string")
    (row,) = registry.stored_files(files, directories, components, repositories, clones).collect()
    assert (row.id, row.path, row.options, row.component) == (1, "/clone/lib/1.2/src/x.cc", ["-DA"], "main")
