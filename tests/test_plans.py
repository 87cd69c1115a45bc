"""Registry, extraction and look-ups on small tables."""

from __future__ import annotations

import pytest

from factfold.operators import allocate, match, resolve, validate
from factfold.plans import extract, registry


def test_prepare_finds_owner_and_portable_arguments(spark):
    commands = spark.createDataFrame([("/r/a", "x.cc", ["g++", "-Iinc", "-o", "x.o", "-c", "x.cc"]), ("/r/a", "x.cc", ["g++", "-Aaa", "/r/a/x.cc"]), ("/r/b", "../a/x.cc", ["ccache", "clangd", "-I", "/else"]), ("/z", "y.cc", ["cc", "y.cc"])], "directory string, file string, arguments array<string>")
    roots = spark.createDataFrame([("whole", "/r"), ("part", "/r/a")], "name string, root string")
    rows = {r.source: r for r in registry.prepare(commands, roots).collect()}
    assert rows.keys() == {"/r/a/x.cc"}
    got = rows["/r/a/x.cc"]
    assert (got.component, got.directory, got.name, got.duplicates, got.driver, got.options, got.working_directory) == ("part", "", "x.cc", 2, "g++", '["-Aaa"]', "<part>")
    assert [r.source for r in registry.outside(commands, roots).collect()] == ["/z/y.cc"]
    assert registry.common_root(commands).first().root in ("", "/")


def test_a_bad_configuration_changes_nothing(spark):
    empty = {"component": spark.createDataFrame([], "id long, name string, path string"), "file": spark.createDataFrame([], "id long, component_id long, directory string, name string, driver string, compile_options string")}
    components = spark.createDataFrame([("a", "/a"), ("b", "/b")], "name string, path string")
    files = lambda *rows: spark.createDataFrame(list(rows), "component_path string, directory string, name string, driver string, compile_options string")
    good = registry.replace_configuration(empty, components, files(("/a", "", "x", "cc", "[]"), ("/b", "d", "y", "cc", "[]")))
    assert sorted((r.id, r.component_id, r.name) for r in good["file"].collect()) == [(1, 1, "x"), (2, 2, "y")]
    for bad in ((components.unionByName(components), files()), (components, files(("/c", "", "x", "cc", "[]"))), (components, files(("/a", "", "", "cc", "[]"))), (components.limit(0), files())):
        with pytest.raises(registry.RegistryError):
            registry.replace_configuration(good, *bad)
    after = registry.replace_configuration(good, components.limit(1), files(("/a", "", "x", "g++", '["-D"]')))["file"]
    assert sorted((r.id, r.driver, r.compile_options) for r in after.collect()) == [(1, "g++", '["-D"]'), (2, None, None)]


def test_clones_are_added_and_taken(spark):
    repositories = spark.createDataFrame([(1, "main", 10)], "id long, name string, active_clone_id long")
    clones = spark.createDataFrame([(10, 1, "/c/one", "one")], "id long, repository_id long, path string, label string")
    same, after = registry.add_clone(repositories, clones, "main", "/c/two", "two")
    assert (same.first().active_clone_id, sorted((r.id, r.path) for r in after.collect())) == (10, [(10, "/c/one"), (11, "/c/two")])
    taken, again = registry.add_clone(repositories, after, "main", "/c/two", "named", activate=True)
    assert (taken.first().active_clone_id, {r.label for r in again.collect()}) == (11, {"one", "named"})
    for bad in (("other", "/x"), ("main", "")):
        with pytest.raises(registry.RegistryError):
            registry.add_clone(repositories, clones, *bad)


def test_old_registries_are_split_whole_or_not_at_all(spark):
    components = spark.createDataFrame([(1, "/r"), (2, "/r/lib")], "id long, root string")
    files = spark.createDataFrame([(7, "/r/lib/a/x.h"), (8, "/r/y.h"), (9, "/r/lib/z.h")], "id long, path string")
    directories, split = registry.split_flat_paths(files, components)
    at = {r.directory_id: (r.component_id, r.directory) for r in directories.collect()}
    assert {r.id: (*at[r.directory_id], r.name) for r in split.collect()} == {7: (2, "a", "x.h"), 8: (1, "", "y.h"), 9: (2, "", "z.h")}
    for row in ((3, "/else/x.h"), (0, "/r/x.h")):
        with pytest.raises(registry.RegistryError):
            registry.split_flat_paths(spark.createDataFrame([row], "id long, path string"), components)


def test_registered_files_keep_their_ids(spark):
    roots = spark.createDataFrame([("/r",)], "root string")
    stored = spark.createDataFrame([(4, "/r/old.h", "/r")], "id long, path string, owner string")
    found = spark.createDataFrame([("/r/b.h",), ("/r/x/../a.h",), ("/r/old.h",), ("/else/c.h",), ("/r/own.db",)], "path string")
    rows = registry.register_files(stored, found, roots, "/r/own.db").collect()
    assert sorted((r.id, r.path) for r in rows) == [(4, "/r/old.h"), (5, "/r/a.h"), (6, "/r/b.h")]


def test_clone_switch_and_names(spark):
    repositories = spark.createDataFrame([(1, "main", 10), (2, "other", 20)], "id long, name string, active_clone_id long")
    clones = spark.createDataFrame([(10, 1, "/c/one", "one"), (11, 1, "/c/two", "two")], "id long, repository_id long, path string, label string")
    after = {r.name: r.active_clone_id for r in registry.switch_clone(repositories, clones, "main", "two").collect()}
    assert after == {"main": 11, "other": 20}
    with pytest.raises(registry.RegistryError):
        registry.switch_clone(repositories, clones, "main", "three")
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    with pytest.raises(registry.RegistryError):
        registry.validate(names)
    with pytest.raises(registry.RegistryError):
        registry.validate(names.distinct(), ["b"])


def test_extraction_gives_the_same_ids_again(spark):
    schema = "file_id long, seq long, usr string, qualified_name string, kind int, line int, col int, is_definition int, is_external int, access string"
    rows = [(1, 1, "u1", "A", 2, 1, 1, 0, 1, "none"), (2, 2, "u1", "A", 2, 5, 1, 1, 0, "public"), (2, 3, "u2", "B", 2, 6, 1, 1, 0, "none"), (2, 4, "", "local", 4, 7, 3, 1, 0, "none")]
    first = extract.symbols(spark.createDataFrame(rows, schema))
    got = {r.qualified_name: r for r in first.collect()}
    assert {n: (r.id >> 32, r.id & 0xFFFFFFFF) for n, r in got.items()} == {"A": (1, 0), "B": (2, 0), "local": (2, 1)}
    assert (got["A"].is_definition, got["A"].is_external, got["A"].access) == (1, 0, "public")
    more = [(2, 1, "u0", "Z", 2, 1, 1, 1, 0, "none"), *[(f, s + 1, *rest) for f, s, *rest in rows]]
    stored = first.select("file_id", "key", "index")
    again = {r.qualified_name: r.id for r in extract.symbols(spark.createDataFrame(more[::-1], schema), stored).collect()}
    assert {n: again[n] for n in got} == {n: r.id for n, r in got.items()}
    assert again["Z"] == (2 << 32) + 2
    edges = spark.createDataFrame([("uu1", "uu2", 1, 0, 1), ("uu1", "uu2", 1, 0, 2), ("uu1", "unknown", 1, 0, 3)], "source_key string, target_key string, kind int, position int, seq int")
    assert [(r.source_id, r.destination_id) for r in extract.edges(edges, first).collect()] == [(got["A"].id, got["B"].id)]


def test_placeholders_follow_the_last_id(spark):
    symbols = spark.createDataFrame([((3 << 32) + 4, "a", 0, 1, 1, 1)], "id long, usr string, is_external int, line int, col int, offset int")
    wanted = spark.createDataFrame([("c",), ("a",), ("b",), ("",), (None,), ("b",)], "usr string")
    rows = {r.usr: (r.id - (3 << 32), r.is_external) for r in resolve.lookup_or_insert(wanted, symbols, 3).collect()}
    assert rows == {"a": (4, 0), "b": (5, 1), "c": (6, 1)}


def test_integrity_and_density(spark):
    parent, child = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,), (2,), (None,)], "parent long")
    assert [tuple(r) for r in validate.fk_violations({"p": parent, "c": child}, [("c", "parent", "p", "id")]).collect()] == [("c", "parent", "p", 1)]
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2)], "file long, index long")
    assert {r.file: (r.n, r.next_index, r.is_dense) for r in allocate.density(rows, "file", "index").collect()} == {1: (2, 2, 1), 2: (2, 3, 0)}


def test_matchers_over_a_tree(spark):
    nodes = spark.createDataFrame([(1, None, "class", False), (2, 1, "method", False), (3, 2, "implicit", True), (4, 3, "call", False), (5, None, "class", False)], "id long, parent_id long, kind string, is_implicit boolean")
    tree = match.Tree(nodes)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(match.all_of(match.kind("class"), match.has_descendant(match.kind("call")))(tree)) == [1]
    assert ids(match.all_of(match.kind("class"), match.unless(match.has(match.kind("method"))))(tree)) == [5]
    assert ids(match.any_of(match.kind("call"), match.has_parent(match.kind("class")))(tree)) == [2, 4]
    assert ids(match.prune(tree, match.kind("method"))) == [1, 5]
    assert {r.id: r.parent_id for r in match.as_spelled(tree).collect()} == {1: None, 2: 1, 4: 2, 5: None}
