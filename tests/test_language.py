"""Tokens, preprocessor events, look-up of names and layout of nested records against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factfold.functions import argv
from factfold.operators import inventory, layout, lexing, lookup

TEXTS = [
    "", " \n", 'a = R"x(no " end )" )y" )x"_s + b;', "'\"' \"'\" 'ab\\'c' u8'x' L\"s\\\"t\"_w", "// goes \\\non\nx \\\n y // last \\", "/* open \" ' R\"(",
    "1'000'000ull 0x1F.8p-3 .5e+3f 1..2 x.y", "a<=>b<<=c->*d...e::f->g%:h", "it's one\nit's two", 'R"(never closed " ', 'R"abc" R"a b(c)a b"', "na\\\nme élan Ünï_1 名前 ²", "x\\", '"open\ny"z"', "\x0b\x0c\t!",
]


def test_pieces_make_the_text_and_have_their_places(spark):
    files = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "id int, t string")
    rows = lexing.lexed(files, "id", "t").orderBy("file", "ordinal").collect()
    for i, t in enumerate(TEXTS):
        mine = [r for r in rows if r.file == i]
        assert [r.ordinal for r in mine] == list(range(len(mine)))
        end = 0
        for r in mine:
            assert t[end : r.offset].replace("\\\n", "").strip(" \t\n\x0b\x0c\r") == ""  # between tokens there is space alone
            assert r.line == t[: r.offset].count("\n") + 1
            size = next(n for n in range(1, len(t) + 1) if t[r.offset : r.offset + n].replace("\\\n", "") == r.spelling or t[r.offset : r.offset + n] == r.spelling)
            end = r.offset + size
        assert t[end:].replace("\\\n", "").strip(" \t\n\x0b\x0c\r") == ""
    assert not [r for r in rows if r.file == 99]


def test_kinds_of_tokens(spark):
    files = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = {}
    for r in lexing.lexed(files, "id", "t").orderBy("file", "ordinal").collect():
        got.setdefault(r.file, []).append((r.kind, r.spelling))
    assert got[2] == [("identifier", "a"), ("mark", "="), ("raw string", 'R"x(no " end )" )y" )x"_s'), ("mark", "+"), ("identifier", "b"), ("mark", ";")]
    assert got[3] == [("character", "'\"'"), ("string", '"\'"'), ("character", "'ab\\'c'"), ("character", "u8'x'"), ("string", 'L"s\\"t"_w')]
    assert got[4] == [("comment", "// goes on"), ("identifier", "x"), ("identifier", "y"), ("comment", "// last \\")]
    assert got[5] == [("comment", TEXTS[5])] and got[9] == [("raw string", TEXTS[9])]
    assert [s for _, s in got[6]] == ["1'000'000ull", "0x1F.8p-3", ".5e+3f", "1..2", "x", ".", "y"]
    assert [s for k, s in got[7] if k == "mark"] == ["<=>", "<<=", "->*", "...", "::", "->", "%", ":"]
    assert got[8] == [("identifier", "it"), ("unknown", "'"), ("identifier", "s"), ("identifier", "one"), ("identifier", "it"), ("unknown", "'"), ("identifier", "s"), ("identifier", "two")]
    assert got[10][:2] == [("identifier", "R"), ("string", '"abc"')] and got[10][2:4] == [("identifier", "R"), ("string", '"a b(c)a b"')]
    assert got[11] == [("identifier", "name"), ("identifier", "élan"), ("identifier", "Ünï_1"), ("identifier", "名前"), ("mark", "²")]
    assert got[13] == [("unknown", '"'), ("identifier", "open"), ("identifier", "y"), ("string", '"z"')]


def test_a_very_long_token_and_many_quotes(spark):
    long = ["'" * 100_001, '"' + "a\\\n" * 100_000 + '"', "/*" + "x\n" * 200_000, 'R"k(' + ')"' * 100_000 + ')k"', "1" + "'0" * 100_000]
    files = spark.createDataFrame(list(enumerate(long)), "id int, t string")
    counted = {r.file: r["count"] for r in lexing.lexed(files, "id", "t").groupBy("file").count().collect()}
    assert [counted[i] for i in range(1, 5)] == [1, 1, 1, 1] and counted[0] >= 1


def events(spark, *texts):
    files = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {}
    for r in lexing.preprocessor_events(files, "id", "t").collect():
        out.setdefault(r.file, []).append((r.line, r.end_line, r.event, r.name, r.value))
    return [out.get(i, []) for i in range(len(texts))]


def test_events_of_directives(spark):
    one, two, three, four, none = events(
        spark,
        '#include <a/b.h>\n# include "c.h" // why\n#define P "p.h"\n#include P\n#define F(x) x\n#ifdef F\nkept\n#else\n#define GONE 1\n#if 1\n#endif\nlost\n#endif\n#ifdef GONE\n#endif\n#undef P',
        "/* \n#define A\n*/ #define B 1\n#define C \\\n  2\nauto s = R\"(\n#define D\n)\";\n#if C == 2 && \\\n defined(B) && !defined A\n#pragma once\n#elif 1\nx\n#endif",
        "#else\n#if 0\na\n#else\n#else\n#endif\n#endif\n#ifndef X\n#if X\nend",
        "#if 1 / 0\n#elif (1 ? 2 : 0) == 2 && -7 / 2 == -3 && 010 == 8 && (1 << 3 | 1) == 9 && ~0 == -1\n#endif\n#if (\n#endif\n#if SELF\n#endif\n#if " + "(" * 100_000 + "\n#endif",
        None,
    )
    assert one == [
        (1, 1, "include", "a/b.h", "angled"), (2, 2, "include", "c.h", "quoted"), (3, 3, "define", "P", '"p.h"'), (4, 4, "include", "p.h", "computed"), (5, 5, "define", "F", "(x) x"),
        (6, 6, "ifdef", "F", "true"), (8, 8, "else", None, "false"), (9, 12, "skipped", None, None), (13, 13, "endif", None, None), (14, 14, "ifdef", "GONE", "false"), (15, 15, "endif", None, None), (16, 16, "undef", "P", None),
    ]
    assert two == [
        (3, 3, "define", "B", "1"), (4, 5, "define", "C", "2"), (9, 10, "if", "C == 2 &&   defined(B) && !defined A", "true"), (11, 11, "pragma", "once", None),
        (12, 12, "elif", "1", "false"), (13, 13, "skipped", None, None), (14, 14, "endif", None, None),
    ]
    assert three == [
        (1, 1, "unbalanced", "else", None), (2, 2, "if", "0", "false"), (3, 3, "skipped", None, None), (4, 4, "else", None, "true"), (5, 5, "unbalanced", "else", None), (6, 6, "endif", None, None),
        (7, 7, "unbalanced", "endif", None), (8, 8, "ifndef", "X", "true"), (9, 9, "if", "X", "false"), (10, 10, "skipped", None, None), (9, 9, "unbalanced", "if", None), (8, 8, "unbalanced", "ifndef", None),
    ]
    assert [e[4] for e in four if e[2] in ("if", "elif")] == ["false", "true", "false", "false", "false"]
    assert none == []


def test_names_are_found_in_the_nearest_scope(spark):
    rng = random.Random(5)
    parent = {0: None} | {i: rng.randrange(max(0, i - 3), i) for i in range(1, 60)}
    declared = [(100 + i, rng.randrange(60), rng.choice("abcd")) for i in range(40)]
    shadow = {d[0]: rng.choice([x[0] for x in declared if x[0] > d[0]] + [900]) for d in declared if rng.random() < 0.5}
    uses = [(i, rng.randrange(60), rng.choice("abcde")) for i in range(200)] + [(500, None, "a"), (501, 3, None), (502, 77, "a")]
    want = set()
    for use, scope, name in uses:
        at = scope
        while at is not None and not (hits := [d for d in declared if d[1:] == (at, name)]):
            at = parent.get(at)
        if at is None:
            want.add((use, None, None, None))
            continue
        for d in hits:
            end = d[0]
            while end in shadow:
                end = shadow[end]
            want.add((use, at, d[0], end))
    frame = spark.createDataFrame
    args = frame(uses, "use int, scope int, name string"), frame(list(parent.items()), "scope int, parent int"), frame(declared, "declaration int, scope int, name string")
    rows = lookup.resolve_names(*args, frame(list(shadow.items()), "shadow int, target int")).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert {r.referred for r in lookup.resolve_names(*args, frame([], "shadow int, target int")).collect()} >= {None}


FIELDS = "record string, position int, type string, size int, align int, bits int"


def laid(spark, records, fields):
    own, whole = layout.composed_layout(spark.createDataFrame(records, "record string, is_union boolean"), spark.createDataFrame(fields, FIELDS))
    return {(r.record, r.position): r.offset for r in own.collect()}, {r.record: (r.size, r.alignment) for r in whole.collect()}


def test_layout_of_records_in_records(spark):
    plain = lambda record, position, bits, width=None: (record, position, None, bits, bits, width)
    fields = [
        ("shape", 0, None, 64, 64, None), ("shape", 1, None, 192, 64, None), plain("point", 0, 64), plain("point", 1, 64), ("circle", 0, "shape", None, None, None), ("circle", 1, "point", None, None, None), plain("circle", 2, 64),
        plain("bits", 0, 32, 3), plain("bits", 1, 32, 30), plain("bits", 2, 8, 2), plain("bits", 3, 32, 0), plain("bits", 4, 8), plain("either", 0, 8), ("either", 1, "point", None, None, None),
        ("holds", 0, "empty", None, None, None), ("holds", 1, "either", None, None, None), ("lost", 0, "unknown", None, None, None), ("lost", 1, None, 8, 8, None), ("behind", 0, "lost", None, None, None),
    ]
    offsets, sizes = laid(spark, [("shape", False), ("point", False), ("circle", False), ("bits", None), ("either", True), ("empty", False), ("holds", False), ("lost", False), ("behind", False)], fields)
    assert sizes == {"shape": (256, 64), "point": (128, 64), "circle": (448, 64), "bits": (96, 32), "either": (128, 64), "empty": (8, 8), "holds": (192, 64)}
    assert [offsets["circle", i] for i in range(3)] == [0, 256, 384]
    assert [offsets["bits", i] for i in range(5)] == [0, 32, 62, 64, 64] and offsets["either", 1] == 0 and offsets["holds", 1] == 64
    with pytest.raises(RuntimeError, match="cycle"):
        laid(spark, [("a", False), ("b", False)], [("a", 0, "b", None, None, None), ("b", 0, "a", None, None, None)])
    assert laid(spark, [("a", False)], []) == ({}, {"a": (8, 8)})


def test_folds_end_at_the_first_failure(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y"), ("b", 1, None), (None, 1, "z"), (None, 2, None)], "g string, n int, e string")
    kept, failures = inventory.fail_fast(rows, "g", "n", "e")
    assert {tuple(r) for r in kept.collect()} == {("a", 1, None), ("b", 1, None)} and {tuple(r) for r in failures.collect()} == {("a", 2, "x"), (None, 1, "z")}


def test_jumps_through_values_reach_what_all_pairs_would(spark):
    jumps = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3), ("f", 1)], "function string, id int")
    labels = spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "x"), ("h", "z")], "function string, label string")
    edges = inventory.computed_jumps(jumps.distinct(), labels).collect()
    pairs = {(a.src, b.dst) for a in edges for b in edges if a.function == b.function and a.dst is None and b.src is None}
    assert pairs == {(1, "x"), (1, "y"), (2, "x"), (2, "y")} and len(edges) == 4


def test_written_literals_and_counts(spark):
    kinds = ["Function", "Subst", "Paren", "Literal", "Literal", "Paren", "Temporary", "Function", "Temporary", "Literal"]
    parents = [None, 0, 1, 2, 0, 0, 5, 5, 7, 8]
    nodes = spark.createDataFrame(list(zip(range(10), parents, kinds, strict=True)), "id int, parent_id int, kind string")
    assert {r.id for r in inventory.written_literals(nodes, "Literal", "Subst", ["Paren"]).collect()} == {4, 9}
    assert {tuple(r) for r in inventory.count_inside(nodes, ["Temporary"], "Function").collect()} == {(0, 1), (7, 1)}


def test_guarded_look_ups(spark):
    symbols = spark.createDataFrame([(7, "u", 1), (8, "", 2), (9, None, 3)], "id int, usr string, node int")
    wanted = spark.createDataFrame([("u",), ("v",), ("",), (None,)], "usr string")
    got = {r.usr: (r.id, r.error is not None) for r in inventory.find_ids(wanted, symbols).collect()}
    assert got == {"u": (7, False), "v": (None, False), "": (None, True), None: (None, True)}
    asked = spark.createDataFrame([(7, 1), (7, 2), (5, 1), (None, None)], "id int, node int")
    assert {(r.id, r.node): r.found for r in inventory.find_nodes(asked, symbols).collect()} == {(7, 1): True, (7, 2): False, (5, 1): False, (None, None): False}


def test_adjusters(spark):
    def adjust(line, *adjusters):
        df = spark.createDataFrame([(line,)], "a array<string>")
        return df.select(argv.adjusted(F.col("a"), F.lit("x.c"), *adjusters)).first()[0]

    assert adjust(["cc", "-o", "-o", "-c", "x.c", "-oy"], argv.strip_output) == ["cc", "-c", "x.c"]
    assert adjust(["cc", "-c", "x.c", "-o"], argv.strip_output, argv.syntax_only) == ["cc", "-fsyntax-only", "x.c"]
    assert adjust(["cc"], argv.insert_arguments(["-v"], at_end=False), *argv.platform_flags("/r")) == ["cc", "-v", "-resource-dir", "/r"]
    assert adjust([], argv.insert_arguments(["-v"])) == ["-v"] and adjust(["cc", "-std=c++20"], argv.insert_arguments(["-std=c++17"], unless="-std")) == ["cc", "-std=c++20"]
