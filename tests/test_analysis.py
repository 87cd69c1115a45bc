"""Components, loops, held items, range scans and declaration rows against plain versions."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factfold.operators import edits, flow, graph, lineage, scan
from factfold.plans import declarations


def plain_reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.append(b)
                break
        else:
            todo.pop()
    return seen


def test_components_and_levels_of_a_random_graph(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(38)} | {(40, 40)}
    nodes = {x for e in edges for x in e}
    reach = {x: plain_reach(edges, x) for x in nodes}
    want = {x: min({y for y in reach[x] if x in reach[y]} | {x}) for x in nodes}
    rows = graph.recursion_groups(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()
    assert {r.node: r.component for r in rows} == want
    assert {r.node for r in rows if r.recursive} == {x for x in nodes if x in reach[x]}
    level = {r.node: r.level for r in rows}
    assert all(level[a] < level[b] for a, b in edges if want[a] != want[b]) and len(rows) == len(nodes)
    with pytest.raises(RuntimeError, match="cycle"):
        graph.levels(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src int, dst int"))


def test_only_frontiers_are_written(spark):
    """A chain: all that reachability leaves is in proportion to its nodes, not to nodes times rounds."""
    before = set(Path(lineage.shared_folder(spark).removeprefix("file:")).glob("cut-*"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node int")).count() == 41
    left = set(Path(lineage.shared_folder(spark).removeprefix("file:")).glob("cut-*")) - before
    assert sum(spark.read.parquet(str(p)).count() for p in left) <= 3 * 41 and len(left) < 40


def test_loops_with_two_entries_are_none(spark):
    edges = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 1), (4, 5), (5, 5), (0, 6), (6, 7), (7, 6), (0, 7), (9, 2)]
    members, loops = flow.natural_loops(spark.createDataFrame(edges, "src int, dst int"), 0)
    assert {(r.header, r.node) for r in members.collect()} == {(1, n) for n in (1, 2, 3, 4)} | {(2, 2), (2, 3), (5, 5)}
    assert {tuple(r) for r in loops.collect()} == {(1, None, 1, 4), (2, 1, 2, 2), (5, None, 1, 1)}


def test_items_held_around_a_loop(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (1, 3), (8, 3)], "src int, dst int")
    at = lambda *rows: spark.createDataFrame(list(rows), "block int, item string")
    starts, blocks = at((0, "m"), (0, "k")), at(*((b, i) for b in (0, 1, 2, 3, 8) for i in "mk"))
    rows = flow.guarded(edges, starts, at((0, "m"), (0, "k")), at((2, "k"), (8, "m")), blocks).collect()
    assert {(r.block, r.item) for r in rows if r.is_guarded} == {(1, "m"), (2, "m"), (3, "m")} and {r.block for r in rows} == {0, 1, 2, 3}


def test_stacks_of_random_events(spark):
    rng, events = random.Random(3), []
    for f in ("a", "b", None):
        events += [(f, i, rng.choice(["enter", "enter", "leave", "leave", "x"])) for i in range(80)]
    want, open_ = {}, {}
    for f, i, k in events:
        own = open_.setdefault(f, [])
        want[f, i] = tuple(own)
        if k == "enter":
            own.append(i)
        elif k == "leave" and own:
            own.pop()
    got = scan.open_regions(spark.createDataFrame(events, "file string, at int, kind string").where("file is not null"), "file", "at", "kind").collect()
    assert {(r.file, r.at): tuple(r.stack) for r in got} == {k: v for k, v in want.items() if k[0]} and all(r.depth == len(r.stack) for r in got)


def test_a_hot_file_is_spread_over_ranges(spark):
    """Half of all edits are of one file: the same rows are rejected, and no task has many times the rows of another."""
    rng = random.Random(6)
    rows = [("hot" if i % 2 else f"f{i % 40}", rng.randrange(4_000), rng.randrange(6), str(i)) for i in range(4_000)]
    got = edits.overlaps(spark.createDataFrame(rows, "file string, offset int, length int, text string"))
    end, want = {}, {}
    for row in sorted(rows):
        file, offset, length, _ = row
        want[row] = int(file in end and offset < end[file])
        end[file] = max(end.get(file, 0), offset + length)
    assert {tuple(r)[:4]: r.rejected for r in got.collect()} == want
    ranges = spark.createDataFrame(rows, "file string, offset int, length int, text string").repartitionByRange(8, "file", "offset").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 2 * len(rows) / len(ranges)
    summed = scan.running_sum(spark.createDataFrame(rows, "file string, offset int, length int, text string"), "file", ["offset", "text"], "length", "before").collect()
    total = {}
    for r in sorted(summed, key=lambda r: (r.file, r.offset, r.text)):
        assert r.before == total.get(r.file, 0)
        total[r.file] = r.before + r.length


def test_declarations_give_facts_skips_and_errors(spark):
    base = {"seq": 1, "file": "f", "is_indexed": True, "is_system": False, "kind": "record", "usr": "u", "qualified_name": "n", "line": 1, "col": 1, "offset": 0, "size": 5, "is_definition": True, "access": "public"}
    known, open_, lost = ({"usr": u, "name": "B", "access": "private", "is_virtual": True, "is_dependent": d} for u, d in (("b", False), (None, True), ("", False)))
    cases = [
        {"bases": [open_, known]}, {"bases": [known, lost]}, {"bases": [known], "is_definition": False}, {"line": None}, {"is_system": True, "usr": ""}, {"is_indexed": None}, {"usr": None}, {"size": -1},
        {"kind": "field", "type": None}, {"kind": "field", "type": "", "owner": "r", "expression": "1.5"}, {"kind": "function", "parameters": [{"name": "p", "type": "t", "type_text": "T", "default_text": '"s"'}, {"name": "q"}], "size": None}, {"kind": "other", "slots": []},
    ]
    rows = spark.createDataFrame([{**base, "seq": i, **c} for i, c in enumerate(cases)], declarations.DECLARATION)
    facts = declarations.Facts(rows)
    of = lambda name, *columns: {(r.seq, *(r[c] for c in columns)) for r in facts.table(name).collect()}
    assert of("relation", "kind", "destination", "position", "is_virtual_base") == {(0, "Inherits", "b", 1, True), (9, "FieldOf", "r", 0, None), (10, "ParamType", "t", 0, None)}
    assert {(i, s, m.rpartition(": ")[2]) for i, s, m in of("problem", "severity", "message")} == {
        (1, "error", "base declaration is unavailable"), (3, "error", "invalid source location"), (4, "skip", "system header"), (5, "skip", "outside indexed files"), (6, "error", "invalid USR"),
        (7, "error", "invalid source range"), (8, "error", "invalid type"),
    }
    assert {i for i, *_ in of("symbol")} == {0, 1, 2, 9, 10, 11}
    assert of("variable_initializer", "evaluated_kind") == {(9, "floating")} and of("parameter_default", "position", "evaluated_kind") == {(10, 0, "string")}
    assert "PartitionFilters: [isnotnull(sink" in facts.table("symbol")._jdf.queryExecution().toString()  # other tables' rows aren't read
    assert declarations.Facts(rows.limit(0)).table("symbol").count() == 0


def test_packs_of_any_depth(spark):
    def flat(v, path=()):
        return [x for i, e in enumerate(v) for x in (flat(e, (*path, i)) if isinstance(e, list) else [((*path, i), e)])]

    import json

    cases = {1: ["a", ["b", ["c", [["d"], []]], "e"], [], [[]]], 2: [], 3: None, 4: ["x"] * 12, 5: [[[[[["deep"]]]]]]}
    rows = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in cases.items()], "owner int, j string").select("owner", F.parse_json("j").alias("v"))
    got = {(r.owner, r.position): (r.value, r.pack_index, r.depth) for r in declarations.template_values(rows, "owner", "v").collect()}
    want = {(k, n): (x, p[1] if len(p) > 1 else -1, len(p) - 1) for k, v in cases.items() if v for n, (p, x) in enumerate(flat(v))}
    assert got == want


@pytest.mark.parametrize("block", [4_096, 7])
def test_missing_cases_of_any_number(spark, block):
    handled = {(i, f"c{j}") for i in range(9) for j in range(60) if (i * 7 + j) % 5} | {(0, None), (None, "c60")}
    own = spark.createDataFrame([(i,) for i in range(11)], "o int")
    got = [tuple(r) for r in edits.missing_cases(own, spark.createDataFrame(list(handled), "o int, c string"), "o", "c", block).collect()]
    assert sorted(got) == sorted((i, f"c{j}") for i in range(11) for j in range(61) if (i, f"c{j}") not in handled)
    assert edits.missing_cases(own, spark.createDataFrame([], "o int, c string"), "o", "c").count() == 0
