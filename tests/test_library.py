"""Functions, sources, store, streaming and graphs on small tables."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factfold import schema
from factfold.functions import argv, flags, ids, paths, text
from factfold.operators import edits, graph, merge, resolve
from factfold.plans import query
from factfold.plans.store import Store, migrate_symbol_flags
from factfold.sources import readers
from factfold.streaming import upsert


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def words(*xs):
    return F.array(*map(F.lit, xs))


def test_packed_ids_survive_large_files(spark):
    packed = ids.pack_id(F.lit((1 << 31) + 5), F.lit(7))
    assert value(spark, ids.file_of(packed)) == (1 << 31) + 5
    assert value(spark, ids.index_of(packed)) == 7


def test_command_lines(spark):
    assert value(spark, argv.sanitise(words("cc", "-I/x/include", "-o", "discard.o", "-DVALUE=1", "-Werror"))) == ["cc", "-I/x/include", "-DVALUE=1"]
    assert value(spark, argv.sanitise(words("cc", "-MF", "dep.d", "a.c"))) == ["cc", "dep.d", "a.c"]
    assert value(spark, argv.skip_launchers(words("ccache", "CC=x", "g++", "a.cc"))) == ["g++", "a.cc"]
    assert value(spark, argv.decode_options(F.lit('["a","b"]'))) == ["a", "b"]
    assert [value(spark, argv.decode_options(F.lit(x))) for x in ('{"invalid":true}', '["a",1]', '["a",null]')] == [None] * 3
    assert value(spark, argv.sanitise(words("-o", "x", "-Xlinker", "-c", "-T", "y", "-DA", "-l", "m"))) == ["-DA", "m"]
    assert value(spark, argv.sanitise(words("ccache", "g++", "-DA"))) == ["-DA"]
    assert value(spark, argv.include_roots(words("cc", "-I", "a", "-isystem", "b", "-Ic", "/Id", "-F=e"))) == ["a", "b", "c", "d", "e"]
    assert value(spark, argv.expand_labels(F.lit("<root>/x <a-b>"), {"root": "/r"})) == "/r/x /a/b"


def test_paths(spark):
    assert value(spark, paths.normalise(F.lit("../b/./c//d"), F.lit("/a/x"))) == "/a/b/c/d"
    assert value(spark, paths.prefixes(F.lit("/a/b"))) == ["/", "/a", "/a/b"]
    assert value(spark, paths.dirname(F.lit("/a"))) == "/"
    assert value(spark, paths.extension(F.lit("x/.bashrc"))) == ""
    assert value(spark, paths.split_version(F.lit("/opt/x/v1.2"))["version"]) == "v1.2"


def test_text(spark):
    assert value(spark, text.tokens(F.lit('int x = 0x1F; // c "q"'))) == ["int", "x", "=", "0x1F", ";", '// c "q"']
    assert value(spark, text.line_of(F.lit("a\nbc\nd"), F.lit(3))) == 2
    assert value(spark, text.column_of(F.lit("a\nbc\nd"), F.lit(3))) == 2
    assert value(spark, text.constant(F.lit('"ready"'))["value"]) == "ready"
    assert value(spark, text.peel(F.lit("const Widget *&"))) == "Widget"


def test_legacy_flags_become_columns(spark):
    row = migrate_symbol_flags(spark.createDataFrame([(1, 27264070)], "id long, flags long")).first()
    assert (row.access, row.is_definition, row.is_const, row.ref_qualifier, row.constant_evaluation) == ("private", 1, 1, "rvalue", "consteval")
    assert (row.has_extern_storage, row.is_noexcept, row.is_override, row.is_abstract) == (1, 1, 0, 0)
    assert value(spark, flags.renumber(F.lit(5), 4, 2)) == 7


def test_merge_is_the_same_in_any_order(spark):
    rows = [("u", 9, 1, 0, 1, "none"), ("u", 10, 2, 1, 1, "private"), ("u", 9, 3, 0, 0, "none")]
    rules = {"file": "first", "defined": "or", "external": "and", "access": "last_but:none"}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "usr string, file int, seq int, defined int, external int, access string")
        assert [tuple(r) for r in merge.merge(df, ["usr"], rules, ["seq"]).collect()] == [("u", 9, 1, 0, "private")]


def test_nested_roots_own_by_the_longest(spark):
    files = spark.createDataFrame([("/a/b/c.h",), ("/a/x.h",), ("/ab/y.h",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r.path: r.owner for r in resolve.longest_prefix_owner(files, "path", roots, "root").collect()} == {"/a/b/c.h": "/a/b", "/a/x.h": "/a", "/ab/y.h": None}


def test_graphs_with_cycles(spark):
    cfg = spark.createDataFrame([(7, 6), (6, 5), (6, 4), (5, 0), (4, 2), (4, 3), (3, 1), (2, 1), (1, 0)], "src long, dst long")
    assert {r.node for r in graph.reachable(cfg, spark.createDataFrame([(7,)], "node long")).collect()} == set(range(8))
    assert graph.cycle_nodes(cfg).collect() == []
    loop = spark.createDataFrame([(2, 4), (2, 1), (3, 2), (4, 3)], "src long, dst long")
    assert {r.node for r in graph.cycle_nodes(loop).collect()} == {2, 3, 4}
    doms = {(r.node, r.dominator) for r in graph.dominators(cfg, 7).collect()}
    assert {d for n, d in doms if n == 1} == {7, 6, 4, 1}
    with pytest.raises(RuntimeError):
        graph.closure(loop, rounds=1)


def test_edits(spark):
    files = spark.createDataFrame([("a", "int* p = NULL;"), ("b", "x")], "file string, text string")
    tokens = spark.createDataFrame([("a", "NULL", 9), ("a", "p", 5)], "file string, spelling string, offset int")
    assert {r.file: r.text for r in edits.rewrite(files, edits.null_literals(tokens)).collect()} == {"a": "int* p = nullptr;", "b": "x"}


def test_query_api(spark):
    assert query.collect(query.query(spark, "SELECT id FROM range(5) WHERE id > ?", lambda r: r.id, 2)) == [3, 4]
    with pytest.raises(query.QueryError, match="raw rows"):
        query.collect(query.rows(spark, "SELECT 1 AS a"))
    for sql, binds in (("SELECT ?", ()), ("SELECT '?'", (1,)), ("SELEC 1", ())):
        with pytest.raises(query.QueryError):
            query.frame(spark, sql, *binds)


def test_store_switches_all_tables_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read_or_none(spark, "symbol") is None
    store.replace(spark, {"symbol": schema.empty(spark, "symbol"), "n": spark.range(2)}, {"v": "1"})
    store.replace(spark, {"n": spark.range(5)})
    assert (store.tables(), store.property("v"), store.read("n").count(), store.read("symbol").count()) == (["n", "symbol"], "1", 5, 0)
    with pytest.raises(KeyError):
        store.read("other")


RULES = {"defined": "or", "external": "and", "line": "first", "kind": "last", "access": "last_but:none", "n": "sum"}


def _sightings(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), i, rng.randint(0, 1), rng.randint(0, 1), rng.randint(1, 9), rng.choice(["x", None]), rng.choice(["none", "public", "private"]), 1) for i in range(60)]
    return spark.createDataFrame(rows, "usr string, seq int, defined int, external int, line int, kind string, access string, n long")


def test_states_of_any_parts_in_any_order_merge_alike(spark):
    rows = _sightings(spark)
    want = sorted(map(tuple, merge.merge(rows, ["usr"], RULES, ["seq"]).collect()))
    parts = [merge.merge_state(rows.where(F.col("seq") % 4 == k), ["usr"], RULES, ["seq"]) for k in (2, 0, 3, 1)]
    two = [merge.merge_states(a.unionByName(b), ["usr"], RULES) for a, b in ((parts[0], parts[1]), (parts[2], parts[3]))]
    assert sorted(map(tuple, merge.settled(merge.merge_states(two[1].unionByName(two[0]), ["usr"], RULES), ["usr"], RULES).collect())) == want


def test_a_stream_in_reverse_order_and_a_replayed_batch(spark, tmp_path):
    rows, src, at = _sightings(spark), str(tmp_path / "in"), str(tmp_path / "states")
    want = sorted(map(tuple, merge.merge(rows, ["usr"], RULES, ["seq"]).collect()))
    for k in (3, 2, 1, 0, None):
        if k is not None:
            rows.where((F.col("seq") >= 15 * k) & (F.col("seq") < 15 * (k + 1))).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        upsert.upsert_stream(stream, at, ["usr"], RULES, ["seq"], str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(x.name for x in Path(at).glob("batch=*")) == [f"batch={k}" for k in range(4)]
    got = lambda where: sorted(map(tuple, upsert.upserted(spark, where, ["usr"], RULES).collect()))
    assert got(at) == want
    merge.merge_state(rows.where("seq >= 45"), ["usr"], RULES, ["seq"]).write.mode("overwrite").parquet(f"{at}/batch=0")  # replayed
    upsert.compact(spark, at, str(tmp_path / "compacted"), ["usr"], RULES)
    assert got(at) == want and got(str(tmp_path / "compacted")) == want


def test_compile_commands(spark, tmp_path):
    at = tmp_path / "compile_commands.json"
    at.write_text('[{"directory": "/d", "file": "a.cc", "arguments": ["cc", "-c", "a.cc"]}, {"directory": "/d", "file": "b.cc", "command": "cc -DX=\\"a b\\" b.cc"}]')
    assert {r.file: r.arguments for r in readers.compile_commands(spark, str(at)).collect()} == {"a.cc": ["cc", "-c", "a.cc"], "b.cc": ["cc", "-DX=a b", "b.cc"]}
