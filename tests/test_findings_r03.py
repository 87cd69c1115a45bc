"""Small cases of the third round's findings: what a query may shuffle, write, or take rounds for."""

from __future__ import annotations

from factfold.operators import edits, lexing


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_constants_are_replaced_without_shuffling_tokens(spark):
    files = spark.createDataFrame([("a", "f(NULL, \"NULL\"); // NULL\nx = __null;"), ("b", ""), ("c", "NULLs")], "file string, text string")
    found = edits.null_literals(lexing.lexed(files, "file", "text"))
    assert "Exchange" not in _plan(found)
    assert sorted((r.file, r.offset, r.length) for r in found.collect()) == [("a", 2, 4), ("a", 29, 6)]
    assert {r.file: r.text for r in edits.rewrite(files, found).collect()} == {"a": "f(nullptr, \"NULL\"); // NULL\nx = nullptr;", "b": "", "c": "NULLs"}


def test_lexing_writes_nothing(spark, tmp_path):
    from factfold.operators.lineage import shared_folder

    listed = lambda: set(p.name for p in __import__("pathlib").Path(shared_folder(spark).removeprefix("file:")).glob("cut-*"))
    before = listed()
    rows = lexing.lexed(spark.createDataFrame([(1, "a b\\\nc d\n+x"), (2, None)], "id int, t string"), "id", "t").collect()
    assert listed() == before
    assert [(r.ordinal, r.offset, r.line, r.kind, r.spelling) for r in rows] == [(0, 0, 1, "identifier", "a"), (1, 2, 1, "identifier", "bc"), (2, 7, 2, "identifier", "d"), (3, 9, 3, "mark", "+"), (4, 10, 3, "identifier", "x")]


def test_components_of_long_rings_and_chains_take_few_rounds(spark):
    from factfold.operators import graph

    cuts = []
    kept, graph.cut = graph.cut, lambda *a, **k: cuts.append(1) or kept(*a, **k)
    try:
        ring = [(i, (i + 1) % 300) for i in range(300)]  # then a chain that leads nowhere, and one round by way of two nodes with several ways
        tail = [(299, 300)] + [(i, i + 1) for i in range(300, 500)]
        eight = [(600, 601), (601, 602), (602, 600), (600, 603), (603, 604), (604, 600), (602, 605), (605, 606), (606, 700)]
        edges = spark.createDataFrame(ring + tail + eight, "src int, dst int")
        own = {r.node: r.component for r in graph.strong_components(edges).collect()}
    finally:
        graph.cut = kept
    assert all(own[i] == 0 for i in range(300)) and all(own[i] == i for i in range(300, 501))
    assert {own[i] for i in range(600, 605)} == {600} and [own[i] for i in (605, 606, 700)] == [605, 606, 700]
    assert len(cuts) < 120


def test_components_equal_those_of_random_graphs(spark):
    import random

    from factfold.operators import graph

    pick = random.Random(5)
    edges = {(g * 100 + pick.randrange(14), g * 100 + pick.randrange(14)) for g in range(60) for _ in range(8 + g % 12)}
    reach = {}
    for a, _ in edges:
        at, seen = [a], set()
        while at:
            x = at.pop()
            new = {d for s, d in edges if s == x} - seen
            seen |= new
            at += new
        reach[a] = seen
    nodes = {x for e in edges for x in e}
    want = {n: min([n, *(m for m in reach.get(n, ()) if n in reach.get(m, ()))]) for n in nodes}
    assert {r.node: r.component for r in graph.strong_components(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()} == want


def test_all_labelled_rows_teach(spark):
    from pyspark.sql import functions as F

    from factfold.llm import quality, toxicity

    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity.labelled(docs, labels, "toxic", F.lit(True)).count() == n
    rows = spark.range(3_001).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("s"))
    for share in (0.0, 0.3, 0.77, 1.0):
        assert abs(quality.quantile(rows, "s", share) - rows.agg(F.percentile("s", F.lit(share))).first()[0]) < 1e-9


def test_a_large_record_is_laid_out_over_ranges(spark):
    from factfold.operators import lessons

    rows = [(o, i, 8 << (i * i + ord(o)) % 4, (8 << (i * i + ord(o)) % 4) * (1 + i % 3)) for o in "abc" for i in range(3 if o == "b" else 900)]
    fields, records = lessons.record_layout(spark.createDataFrame(rows, "o string, p long, a int, s int"), "o", "p", "s", "a")
    want, sizes = set(), set()
    for o in "abc":
        end = 0
        mine = sorted(r for r in rows if r[0] == o)
        for _, p, a, s in mine:
            at = -(-end // a) * a
            want.add((o, p, at))
            end = at + s
        most = max(r[2] for r in mine)
        sizes.add((o, -(-end // most) * most, most))
    assert {tuple(r) for r in fields.collect()} == want and {tuple(r) for r in records.collect()} == sizes
    assert "collect_list" not in records._jdf.queryExecution().analyzed().toString()
    assert lessons._ends([(4, 4), (8, 8), (1, 1)], 8) == [17] + [17] * 4 + [25] * 3


def test_texts_without_comments_and_raw_strings_are_not_cut_into_tokens(spark):
    texts = [(1, "#define A 1\n#if A\n\"#\\\n\"\n#endif"), (2, "/* \n#define A\n*/\n#ifdef A\n#endif // x"), (3, "u8R\"q(\n#if 1\n)q\"\n#else"), (4, "L\"R\" \\\n#pragma x\n#pragma y")]
    rows = lexing.preprocessor_events(spark.createDataFrame(texts, "id int, t string"), "id", "t").collect()
    assert sorted((r.file, r.line, r.event, r.value or "") for r in rows) == [
        (1, 1, "define", "1"), (1, 2, "if", "true"), (1, 5, "endif", ""), (2, 4, "ifdef", "false"), (2, 5, "endif", ""), (3, 4, "unbalanced", ""), (4, 3, "pragma", ""),
    ]


def test_closure_makes_a_pair_once_per_middle_and_deals_pairs_by_their_number(spark, monkeypatch):
    import random

    from factfold.operators import graph

    plans = []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, *a: plans.append(_plan(df)) or kept(df, *a))
    monkeypatch.setattr(graph, "ROWS_OF_A_TASK", 100)
    pick = random.Random(3)
    edges = {(i, i + 1) for i in range(40)} | {(100 + pick.randrange(12), 100 + pick.randrange(12)) for _ in range(18)} | {(200, 200)}
    want = {}
    for a in {s for s, _ in edges}:
        at, d = {a}, 0
        while at:
            d += 1
            at = {t for s, t in edges if s in at and (a, t) not in want}
            want |= {(a, t): d for t in at}
    found = [(r.src, r.dst, r.distance) for r in graph.closure(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()]
    assert len(found) == len(want) and {(s, t): d for s, t, d in found} == want
    rounds = [p for p in plans if "SortMergeJoin" in p]
    assert len(rounds) == 6 and "REPARTITION_BY_NUM" in rounds[-1]
    for p in rounds:  # pairs are shuffled before they are aggregated: no task gathers what another one aggregates again
        assert "BroadcastHashJoin" not in p and "partial_min" in p and p.index("partial_min") < p.index("REPARTITION_BY_NUM")


def _joins_of_cuts(monkeypatch, most):
    """The plans that loops write, when tables of more than most rows may not be sent."""
    from factfold.operators import flow, graph, layout, lineage, lookup

    plans = []
    kept = lineage.cut
    monkeypatch.setattr(lineage, "MOST_SENT", most)
    for module in (flow, graph, layout, lookup):
        monkeypatch.setattr(module, "cut", lambda df, *a, **k: plans.append(_plan(df)) or kept(df, *a, **k))
    return plans


def test_layout_of_nested_records_sends_no_large_table_to_the_driver(spark, monkeypatch):
    from factfold.operators import layout

    plans = _joins_of_cuts(monkeypatch, -1)
    records = spark.createDataFrame([(i, False) for i in range(1, 16)], "record long, is_union boolean")
    fields = [(i, 0, i // 2 or None, None if i > 1 else 16, None if i > 1 else 16, None) for i in range(1, 16)] + [(i, 1, None, 8, 8, None) for i in range(1, 16)]
    out, sizes = layout.composed_layout(records, spark.createDataFrame(fields, "record long, position int, type long, size int, align int, bits int"))
    depth = lambda i: i.bit_length()
    assert {r.record: (r.size, r.alignment) for r in sizes.collect()} == {i: (16 * (1 + depth(i)), 16) for i in range(1, 16)}
    assert {(r.record, r.position): r.offset for r in out.collect()} == {(i, k): k * 16 * depth(i) for i in range(1, 16) for k in (0, 1)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_loops_and_held_items_send_no_large_table_to_the_driver(spark, monkeypatch):
    from factfold.operators import flow

    plans = _joins_of_cuts(monkeypatch, -1)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 2), (3, 1), (3, 4)], "src int, dst int")
    members, loops = flow.natural_loops(edges, 0)
    assert {(r.header, r.node) for r in members.collect()} == {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)}
    assert {tuple(r) for r in loops.collect()} == {(1, None, 1, 3), (2, 1, 2, 2)}
    item = lambda *blocks: spark.createDataFrame([(b, 7) for b in blocks], "block int, item int")
    held = flow.guarded(edges, item(0), item(1), item(3), item(0, 1, 2, 3, 4, 9))
    assert {r.block: r.is_guarded for r in held.collect()} == {0: False, 1: False, 2: False, 3: False, 4: False}
    held = flow.guarded(edges, item(0), item(1), item(4), item(1, 2, 4))
    assert {r.block: r.is_guarded for r in held.collect()} == {1: False, 2: True, 4: True}
    for df in (members, loops, held):
        plans.append(_plan(df))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_a_changed_path_is_in_a_plan_once(spark):
    from pyspark.sql import functions as F

    from factfold.functions import argv, paths

    lines = [(1, ["cc", "-I", "~/a/../b", "-I<lib>/x", "--sysroot", "-I", "--sysroot=~/s", "$ROOT/y", "-F$ROOT/./y"]), (2, ["-I"]), (3, []), (4, ["cc", "-I", None, "-I/r/q", "--sysroot=/r", None])]
    df = spark.createDataFrame(lines, "id int, line array<string>")
    resolved = argv.resolve_includes(F.col("line"), lambda v: argv.resolve_path(v, {"lib": "/lib"}, {"ROOT": "/r"}, "/h", "/w"))
    stored = argv.portable_includes(F.col("line"), lambda v: paths.portable(paths.normalise(v, F.lit("/w")), F.lit("/r"), F.lit("r")))
    found = df.select("id", resolved.alias("resolved"), stored.alias("stored"))
    rows = {r.id: (r.resolved, r.stored) for r in found.collect()}
    assert rows[1][0] == ["cc", "-I", "/h/b", "-I/lib/x", "--sysroot", "-I", "--sysroot=~/s", "$ROOT/y", "-F/r/y"]
    assert rows[1][1] == ["cc", "-I", "/w/~/b", "-I/w/<lib>/x", "--sysroot", "/w/-I", "--sysroot=/w/~/s", "$ROOT/y", "-F/w/$ROOT/y"]
    assert rows[2] == (["-I"], ["-I"]) and rows[3] == ([], [])
    assert rows[4][1][3:] == ["-I<r>/q", "--sysroot=<r>", None]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2  # labels and variables, once each


def test_nodes_of_a_forest_are_numbered_in_few_rounds(spark, monkeypatch):
    import random

    from factfold.operators import graph

    cuts = []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, *a: cuts.append(1) or kept(df, *a))
    pick = random.Random(9)
    parent = {i: i - 1 for i in range(1, 100)} | {i: pick.randrange(i) for i in range(100, 180) if i % 20} | {300: 301}
    single = [5, 302, 303]
    above = {n: [] for n in {*parent, *parent.values(), *single}}
    for n in above:
        at = n
        while at in parent:
            at = parent[at]
            above[n].append(at)
    frame = lambda rows: spark.createDataFrame(rows, "node int, parent int")
    others = spark.createDataFrame([(n,) for n in single], "node int")
    found = {r.node: (r.first, r.last) for r in graph.intervals(frame(list(parent.items())), others).collect()}
    assert found.keys() == above.keys() and sorted(f for f, _ in found.values()) == list(range(1, len(above) + 1))
    assert all((found[b][0] < found[a][0] <= found[b][1]) == (b in above[a]) for a in found for b in found)
    assert len(cuts) < 25
    for odd in ([(1, 2), (1, 3)], [(1, 1)], [(1, 2), (2, 3), (3, 1), (4, 1)]):
        assert graph.intervals(frame(odd), others) is None


def test_names_are_placed_once_and_not_passed_up_scope_by_scope(spark, monkeypatch):
    from factfold.operators import graph, lookup, scan

    cuts = []
    kept = lookup.cut
    for module in (graph, lookup, scan):
        monkeypatch.setattr(module, "cut", lambda df, *a, **k: cuts.append(1) or kept(df, *a, **k))
    monkeypatch.setattr(lookup, "ROWS_OF_A_TASK", 10)  # so that names span ranges
    frame = spark.createDataFrame
    n = 240
    scopes = frame([(i, i - 1 if i else None) for i in range(n)] + [(n + i, i) for i in range(0, n, 3)], "scope int, parent int")  # a chain, and scopes beside it
    declared = frame([(1, 0, "far"), (2, 0, "far"), (3, 40, "near"), (4, 80, "near"), (5, n + 60, "near"), (6, 999, "apart")], "declaration int, scope int, name string")
    uses = frame([(1000 * k + i, i, name) for i in (0, 40, 79, n - 1, n + 36, n + 60, 2 * n - 3, 999) for k, name in enumerate(("far", "near", "none", "apart"))], "use int, scope int, name string")
    found = [tuple(r) for r in lookup.resolve_names(uses, scopes, declared, frame([(3, 7)], "shadow int, target int")).collect()]

    def holder(scope, name):
        if scope == 999 or name in ("none", "apart"):
            return 999 if (scope, name) == (999, "apart") else None
        on = scope if scope < n else scope - n
        return 0 if name == "far" else scope if scope == n + 60 else 80 if on >= 80 else 40 if on >= 40 else None

    held = {(0, "far"): [(1, 1), (2, 2)], (40, "near"): [(3, 7)], (80, "near"): [(4, 4)], (n + 60, "near"): [(5, 5)], (999, "apart"): [(6, 6)]}
    want = [(u, h, *d) for u, s, name in (tuple(r) for r in uses.collect()) for h in [holder(s, name)] for d in held.get((h, name), [(None, None)])]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert len(cuts) < 60, len(cuts)  # a round for each scope on the way takes more


def test_names_in_scopes_that_are_no_forest_are_found_on_the_way_up(spark):
    from factfold.operators import lookup

    frame = spark.createDataFrame
    scopes = frame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (5, 7)], "scope int, parent int")  # a circle, and a scope with two parents
    declared = frame([(20, 2, "a"), (60, 6, "a"), (70, 7, "a")], "declaration int, scope int, name string")
    uses = frame([(1, 1, "a"), (2, 4, "a"), (3, 5, "a"), (4, 2, "a")], "use int, scope int, name string")
    rows = lookup.resolve_names(uses, scopes, declared, frame([], "shadow int, target int")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, 20, 20), (2, 2, 20, 20), (3, 6, 60, 60), (3, 7, 70, 70), (4, 2, 20, 20)]
