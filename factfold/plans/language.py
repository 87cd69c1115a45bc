"""Registered queries of source texts and scopes: tokens with their places, preprocessor events, look-up of names, layout of nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.functions import argv, text
from factfold.operators import edits, inventory, layout, lexing, lookup
from factfold.plans import query as statements
from factfold.plans import registry
from factfold.plans.registered import TOKEN_SQL, big, query

# Texts within a raw string, a string, a comment or a statement with character literals and marks, by document.
_PLANTED = r"""p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'auto s = u8R"x' || doc_id % 3 || '(' || text || ')" // )x' || doc_id % 3 || '"_s; c = ''"'' <=> 0x1''F.p-3;'
  WHEN 1 THEN 'f(' || text || ', "a\"b", L''\'''')->*g;' || chr(10) || '// ' || doc_id || '\' || chr(10) || 'goes on' || chr(10) || '#define' WHEN 2 THEN '/* ' || text || ' // */ x>>=.5e+3f;' ELSE text END AS text FROM documents)"""


def _planted(t):
    n, text = F.col("doc_id") % 4, F.col("text")
    third = (F.col("doc_id") % 3).cast("string")
    raw = F.concat(F.lit('auto s = u8R"x'), third, F.lit("("), text, F.lit(')" // )x'), third, F.lit("\"_s; c = '\"' <=> 0x1'F.p-3;"))
    call = F.concat(F.lit("f("), text, F.lit(", \"a\\\"b\", L'\\'')->*g;\n// "), F.col("doc_id").cast("string"), F.lit("\\\ngoes on\n#define"))
    spelled = F.when(n == 0, raw).when(n == 1, call).when(n == 2, F.concat(F.lit("/* "), text, F.lit(" // */ x>>=.5e+3f;"))).otherwise(text)
    return t.documents.select("doc_id", spelled.alias("text"))


@query(rf"""WITH {_PLANTED}, x AS (SELECT doc_id, unnest(v) AS s, unnest(range(len(v))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS v FROM p)),
k AS (SELECT *, CASE WHEN regexp_matches(s, '^(?:[ \t\n\x0B\f\r]|\\\r?\n)') THEN 'space' WHEN s LIKE '//%' OR s LIKE '/*%' THEN 'comment' WHEN s IN ('"', '''') THEN 'unknown' WHEN regexp_matches(s, '^(?:u8|[uUL])?R"') THEN 'raw string'
    WHEN regexp_matches(s, '^(?:u8|[uUL])?"') THEN 'string' WHEN regexp_matches(s, '^(?:u8|[uUL])?''') THEN 'character' WHEN regexp_matches(s, '^\.?[0-9]') THEN 'number' WHEN regexp_matches(s, '^[\p{{L}}_]') THEN 'identifier' ELSE 'mark' END AS kind,
  coalesce(sum(length(s)) OVER w, 0)::BIGINT AS o, (coalesce(sum(length(s) - length(replace(s, chr(10), ''))) OVER w, 0) + 1)::BIGINT AS line FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id AS file, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, o AS "offset", line, kind, CASE WHEN kind = 'raw string' THEN s ELSE regexp_replace(s, '\\\r?\n', '', 'g') END AS spelling FROM k WHERE kind <> 'space'""")
def lexed_tokens(t):
    """All tokens with their places, of texts that stand in raw strings, comments that go on, and between character literals."""
    return lexing.lexed(_planted(t), "doc_id", "text")


# Before ten of thirteen lines of each text stands a directive; which one and about which of three macros depends on document and line.
_DIRECTIVES = """CASE h WHEN 0 THEN '#define M' || k || ' ' || i % 4 WHEN 1 THEN '# undef M' || k WHEN 2 THEN '#ifdef M' || k WHEN 3 THEN '#ifndef M' || k WHEN 4 THEN '#else' WHEN 5 THEN '  #endif'
  WHEN 6 THEN '#include "f' || i || '.h"' WHEN 7 THEN '#if M' || k || ' > 1' WHEN 8 THEN '#elif (M' || k || ' - 1) < 0' WHEN 9 THEN '#pragma once' END"""
_H = "CAST((doc_id * 7 + i * 5) % 13 AS INT) AS h, CAST((doc_id + i) % 3 AS INT) AS k"


@query(f"""WITH RECURSIVE n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT *, {_H} FROM (SELECT doc_id, unnest(range(n)) AS i FROM n)),
d AS MATERIALIZED (SELECT doc_id, h, k, i, i % 4 AS v, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, i + row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line FROM p WHERE h < 10),
z AS (SELECT doc_id, max(n) + count(h) AS total, count(h) AS last FROM n LEFT JOIN d USING (doc_id) GROUP BY 1),
r(doc_id, rn, m, st, line, h, k, i, v, emits, odd, test, cut) AS (
  SELECT doc_id, 0::BIGINT, [NULL, NULL, NULL]::BIGINT[], []::STRUCT(name VARCHAR, head BIGINT, pos BIGINT, parent BOOLEAN, taken BOOLEAN, is_on BOOLEAN, last BOOLEAN)[], 0::BIGINT, 99, 0, 0::BIGINT, 0::BIGINT, false, false, false, NULL::BIGINT FROM n
  UNION ALL SELECT doc_id, rn, CASE WHEN act AND h = 0 THEN [CASE WHEN k = 0 THEN v ELSE m[1] END, CASE WHEN k = 1 THEN v ELSE m[2] END, CASE WHEN k = 2 THEN v ELSE m[3] END]
      WHEN act AND h = 1 THEN [CASE WHEN k <> 0 THEN m[1] END, CASE WHEN k <> 1 THEN m[2] END, CASE WHEN k <> 2 THEN m[3] END] ELSE m END,
    CASE WHEN h IN (2, 3, 7) THEN list_append(st, {{'name': CASE h WHEN 2 THEN 'ifdef' WHEN 3 THEN 'ifndef' ELSE 'if' END, 'head': line, 'pos': line, 'parent': act, 'taken': test, 'is_on': test, 'last': false}})
      WHEN odd THEN st WHEN h IN (4, 8) THEN list_append(st[:-2], {{'name': tip.name, 'head': tip.head, 'pos': line, 'parent': tip.parent, 'taken': tip.taken OR test, 'is_on': test, 'last': h = 4}}) WHEN h = 5 THEN st[:-2] ELSE st END,
    line, h, k, i, v, CASE WHEN h IN (4, 5, 8) THEN coalesce(tip.parent, true) ELSE act END, odd, test, CASE WHEN h IN (4, 5, 8) AND NOT odd AND tip.parent AND NOT tip.is_on AND line - 1 > tip.pos THEN tip.pos + 1 END
  FROM (SELECT *, CASE WHEN h IN (2, 3, 7) THEN act AND holds WHEN h IN (4, 8) AND NOT odd THEN tip.parent AND NOT tip.taken AND holds ELSE false END AS test
    FROM (SELECT d.*, m, st, tip, coalesce(tip.is_on, true) AS act, (d.h IN (4, 8) AND (tip IS NULL OR tip.last)) OR (d.h = 5 AND tip IS NULL) AS odd,
      CASE d.h WHEN 2 THEN m[d.k + 1] IS NOT NULL WHEN 3 THEN m[d.k + 1] IS NULL WHEN 7 THEN coalesce(m[d.k + 1], 0) > 1 WHEN 8 THEN coalesce(m[d.k + 1], 0) - 1 < 0 ELSE true END AS holds
    FROM (SELECT doc_id, rn, m, st, CASE WHEN len(st) > 0 THEN st[-1] END AS tip FROM r) q JOIN d ON d.doc_id = q.doc_id AND d.rn = q.rn + 1))),
e AS (SELECT doc_id, rn, m, st, line, h, k, i, v, emits, odd, test, cut FROM r WHERE rn > 0), o AS (SELECT doc_id, unnest(st) AS s, total FROM r JOIN z USING (doc_id) WHERE rn = last)
SELECT doc_id AS file, line, line AS end_line, CASE WHEN odd THEN 'unbalanced' ELSE ['define', 'undef', 'ifdef', 'ifndef', 'else', 'endif', 'include', 'if', 'elif', 'pragma'][h + 1] END AS event,
  CASE WHEN odd THEN ['else', 'endif', NULL, NULL, 'elif'][h - 3] WHEN h IN (0, 1, 2, 3) THEN 'M' || k WHEN h = 6 THEN 'f' || i || '.h' WHEN h = 7 THEN 'M' || k || ' > 1' WHEN h = 8 THEN '(M' || k || ' - 1) < 0' WHEN h = 9 THEN 'once' END AS name,
  CASE WHEN odd THEN NULL WHEN h = 0 THEN v::VARCHAR WHEN h IN (2, 3, 4, 7, 8) THEN test::VARCHAR WHEN h = 6 THEN 'quoted' END AS value FROM e WHERE emits
UNION ALL SELECT doc_id, cut, line - 1, 'skipped', NULL, NULL FROM e WHERE cut IS NOT NULL
UNION ALL SELECT doc_id, s.head, s.head, 'unbalanced', s.name, NULL FROM o WHERE s.parent UNION ALL SELECT doc_id, s.pos + 1, total, 'skipped', NULL, NULL FROM o WHERE s.parent AND NOT s.is_on AND total > s.pos""")
def preprocessor_events(t):
    """Inclusions, definitions, conditionals and skipped lines of all texts, with directives before most of their lines."""
    lines = t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    before = lines.select("doc_id", "i", "x", F.expr("CAST((doc_id * 7 + i * 5) % 13 AS INT)").alias("h"), F.expr("CAST((doc_id + i) % 3 AS INT)").alias("k"))
    said = before.select("doc_id", "i", F.concat_ws("\n", F.expr(_DIRECTIVES), "x").alias("x"))
    files = said.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]), "\n").alias("text"))
    return lexing.preprocessor_events(files, "doc_id", "text")


# Scopes are parts in a binary tree; every third declares its brand, every fifth of all is a shadow of the part at a fifth of its key.
@query("""WITH RECURSIVE d AS MATERIALIZED (SELECT p_partkey AS p, p_brand AS name FROM part WHERE p_partkey % 3 = 0),
a(use, scope, name) AS (SELECT l_orderkey * 1000 + l_linenumber, l_partkey, 'Brand#' || l_suppkey % 25 FROM lineitem), q(s, name, pos) AS (SELECT DISTINCT scope, name, scope FROM a
  UNION ALL SELECT s, name, pos // 2 FROM q WHERE pos > 0 AND (pos, name) NOT IN (SELECT (p, name) FROM d)),
h AS (SELECT s, name, pos FROM q WHERE (pos, name) IN (SELECT (p, name) FROM d)), c(p, last) AS (SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 0 UNION ALL SELECT p, last // 5 FROM c WHERE last % 5 = 0 AND last > 0),
l AS (SELECT p, min(last) AS last FROM c GROUP BY 1)
SELECT use, pos AS holder, pos AS found, coalesce(last, pos) AS referred FROM a LEFT JOIN h ON a.scope = h.s AND a.name = h.name LEFT JOIN l ON l.p = pos""")
def resolved_names(t):
    """Lines use a brand in the scope of their part: the nearest scope around that declares it, and what is behind the shadow found there."""
    p = F.col("p_partkey")
    scopes = t.part.select(p.alias("scope"), F.when(p > 0, big(F.floor(p / 2))).alias("parent"))
    declarations = t.part.where(p % 3 == 0).select(p.alias("declaration"), p.alias("scope"), F.col("p_brand").alias("name"))
    shadows = t.part.where((p % 5 == 0) & (p > 0)).select(p.alias("shadow"), big(F.floor(p / 5)).alias("target"))
    name = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25).cast("string"))
    uses = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("use"), F.col("l_partkey").alias("scope"), name.alias("name"))
    return lookup.resolve_names(uses, scopes, declarations, shadows)


# Records are parts with one to five fields: plain ones, bit-fields, and the record of half the key; every seventh is a union.
_RECORDS = """WITH RECURSIVE p AS (SELECT p_partkey AS p, p_size AS z FROM part), r(p, l) AS (SELECT p, {fold} FROM p WHERE p = 0
UNION ALL SELECT p.p, {inner} FROM r JOIN p ON p.p // 2 = r.p AND p.p > 0)"""
_UP = "(({0}) + ({1}) - 1) // ({1}) * ({1})"
_FOLD = f"""list_reduce(list_transform(range(p.p % 5 + 1), lambda k: CASE WHEN p.p > 0 AND (p.p + k) % 3 = 0 THEN {{{{'k': k, 's': {{s}}, 'a': {{a}}, 'b': NULL::BIGINT, 'out': []::BIGINT[][]}}}}
  ELSE {{{{'k': k, 's': (8 * (1 << ((z + k) % 4)::INT))::BIGINT, 'a': (8 * (1 << ((z + k) % 4)::INT))::BIGINT, 'b': CASE WHEN (p.p + k) % 5 = 1 THEN ((p.p * k) % (8 * (1 << ((z + k) % 4)::INT)))::BIGINT END, 'out': []::BIGINT[][]}}}} END),
  lambda t, f: {{{{'k': f.k, 's': CASE WHEN p.p % 7 = 3 THEN greatest(t.s, coalesce(f.b, f.s)) ELSE (CASE WHEN f.b > 0 AND t.s // f.s = (t.s + f.b - 1) // f.s THEN t.s ELSE {_UP.format("t.s", "f.a")} END) + coalesce(f.b, f.s) END,
    'a': CASE WHEN f.b = 0 THEN t.a ELSE greatest(t.a, f.a) END, 'b': NULL::BIGINT,
    'out': list_append(t.out, [f.k, CASE WHEN p.p % 7 = 3 THEN 0 WHEN f.b > 0 AND t.s // f.s = (t.s + f.b - 1) // f.s THEN t.s ELSE {_UP.format("t.s", "f.a")} END, coalesce(f.b, f.s)]::BIGINT[])}}}},
  {{{{'k': 0::BIGINT, 's': 0::BIGINT, 'a': 8::BIGINT, 'b': NULL::BIGINT, 'out': []::BIGINT[][]}}}})"""
_NESTED = _RECORDS.format(fold=_FOLD.format(s="0::BIGINT", a="8::BIGINT"), inner=_FOLD.format(s=f"greatest(8, {_UP.format('r.l.s', 'r.l.a')})::BIGINT", a="r.l.a"))


def _records(t):
    p, k = F.col("record"), F.col("position")
    fields = t.part.select(F.col("p_partkey").alias("record"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 5)).alias("position"), "p_size")
    align = big(F.expr("8 * shiftleft(1, int((p_size + position) % 4))"))
    held = (p > 0) & ((p + k) % 3 == 0)
    bits = F.when(~held & ((p + k) % 5 == 1), (p * k) % align)
    records = t.part.select(F.col("p_partkey").alias("record"), (F.col("p_partkey") % 7 == 3).alias("is_union"))
    return records, fields.select("record", "position", F.when(held, big(F.floor(p / 2))).alias("type"), F.when(~held, align).alias("size"), F.when(~held, align).alias("align"), bits.alias("bits"))


@query(f"{_NESTED} SELECT p AS record, o[1] AS position, o[2] AS \"offset\", o[3] AS size FROM (SELECT p, unnest(l.out) AS o FROM r)")
def nested_offsets(t):
    """Offsets of fields of records that hold records, unions and bit-fields."""
    return layout.composed_layout(*_records(t))[0]


@query(f"{_NESTED} SELECT p AS record, greatest(8, {_UP.format('l.s', 'l.a')})::BIGINT AS size, l.a AS alignment FROM r")
def nested_sizes(t):
    return layout.composed_layout(*_records(t))[1]


# Nodes are parts in a binary tree, kinds by key.
_KINDS = ["IntegerLiteral", "ParenExpr", "CXXMemberCallExpr", "SubstNonTypeTemplateParmExpr", "IntegerLiteral", "MaterializeTemporaryExpr", "FunctionDecl", "CallExpr", "UserDefinedLiteral", "CXXOperatorCallExpr", "ImplicitCastExpr"]
_TREE = f"n AS MATERIALIZED (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent, {_KINDS}[1 + p_partkey % 11] AS kind FROM part)"
_TRANSPARENT = ["ParenExpr", "ImplicitCastExpr"]


def _tree(t):
    p = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (1 + p % 11).cast("int"))
    return t.part.select(p.alias("id"), F.when(p > 0, big(F.floor(p / 2))).alias("parent_id"), kind.alias("kind"))


@query(f"WITH {_TREE} SELECT id, kind, CASE kind WHEN 'CallExpr' THEN 'plain' WHEN 'CXXMemberCallExpr' THEN 'member' WHEN 'CXXOperatorCallExpr' THEN 'operator' ELSE 'literal' END AS family, kind <> 'UserDefinedLiteral' AS has_written_arguments FROM n WHERE kind LIKE '%CallExpr' OR kind = 'UserDefinedLiteral'")
def call_population(t):
    return inventory.calls(_tree(t))


@query(f"""WITH RECURSIVE {_TREE}, u(id, up) AS (SELECT id, parent FROM n WHERE kind = 'IntegerLiteral' UNION ALL SELECT u.id, n.parent FROM u JOIN n ON n.id = u.up WHERE n.kind IN ('ParenExpr', 'ImplicitCastExpr'))
SELECT id FROM n WHERE kind = 'IntegerLiteral' AND id NOT IN (SELECT u.id FROM u JOIN n ON n.id = u.up WHERE n.kind = 'SubstNonTypeTemplateParmExpr')""")
def literals_in_source(t):
    """Literals that somebody wrote, whatever casts and parentheses stand between them and a replaced template parameter."""
    return inventory.written_literals(_tree(t), "IntegerLiteral", "SubstNonTypeTemplateParmExpr", _TRANSPARENT)


@query(f"""WITH RECURSIVE {_TREE}, u(id, up) AS (SELECT id, parent FROM n WHERE kind = 'MaterializeTemporaryExpr' UNION ALL SELECT u.id, n.parent FROM u JOIN n ON n.id = u.up WHERE n.kind <> 'FunctionDecl'),
o AS (SELECT n.id, count(*) AS n FROM u JOIN n ON n.id = u.up WHERE n.kind = 'FunctionDecl' GROUP BY 1) SELECT id, coalesce(o.n, 0) AS n FROM n LEFT JOIN o USING (id) WHERE kind = 'FunctionDecl'""")
def temporaries_inside(t):
    """Temporaries by the nearest function around them."""
    return inventory.count_inside(_tree(t), ["MaterializeTemporaryExpr"], "FunctionDecl")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '2-HIGH' AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND l_returnflag = 'R' AND p_type = 'ECONOMY')""")
def specialisations_of_template(t):
    """Specialisations of one template whose second argument points to one record."""
    facts = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("template"))
    arguments = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("type_id"), (F.col("l_returnflag") == "R").alias("is_pointer"))
    return inventory.specialisations(facts, arguments, t.part.select(F.col("p_partkey").alias("type_id"), F.col("p_type").alias("name")), "2-HIGH", 2, "ECONOMY")


_JUMPS = "j AS (SELECT o_custkey AS function, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'), l AS (SELECT DISTINCT o_custkey AS function, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F')"


@query(f"""WITH {_JUMPS} SELECT function, id AS src, NULL AS dst FROM j WHERE function IN (SELECT function FROM l) UNION ALL SELECT function, NULL, label FROM l WHERE function IN (SELECT function FROM j)""")
def computed_jumps(t):
    """Jumps through a value go to every label of their function whose address is taken, by way of one node per function."""
    function = F.col("o_custkey").alias("function")
    jumps, labels = t.orders.where("o_orderstatus = 'O'"), t.orders.where("o_orderstatus = 'F'")
    return inventory.computed_jumps(jumps.select(function, F.col("o_orderkey").alias("id")), labels.select(function, F.col("o_orderpriority").alias("label")))


_STEPS = "s AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed at ' || event_id END AS error FROM events), f AS (SELECT user_id, min(event_id) AS first FROM s WHERE error IS NOT NULL GROUP BY 1)"


@query(f"WITH {_STEPS} SELECT s.* FROM s LEFT JOIN f USING (user_id) WHERE first IS NULL OR event_id <= first")
def fail_fast(t):
    """Each user's steps up to the first that fails, and that one; what comes after goes."""
    failed = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.concat(F.lit("failed at "), F.col("event_id").cast("string")))
    kept, failures = inventory.fail_fast(t.events.select("user_id", "event_id", failed.alias("error")), "user_id", "event_id", "error")
    return kept.unionByName(failures)


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Brand#' || doc_id % 40 END AS usr, CASE WHEN doc_id % 5 > 1 THEN (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#' || doc_id % 40) END AS id,
CASE WHEN doc_id % 5 <= 1 THEN 'a symbol needs a usr' END AS error FROM documents""")
def find_by_usr(t):
    """Empty and missing names are errors, names of no symbol are nulls."""
    n = F.col("doc_id") % 5
    wanted = t.documents.select("doc_id", F.when(n == 0, "").when(n > 1, F.concat(F.lit("Brand#"), (F.col("doc_id") % 40).cast("string"))).alias("usr"))
    return inventory.find_ids(wanted, t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("usr")))


@query("SELECT l_orderkey, l_linenumber, l_orderkey AS id, l_returnflag AS node, coalesce((SELECT o_orderstatus FROM orders WHERE o_orderkey = l_orderkey) = CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END, false) AS found FROM lineitem")
def find_by_id_and_node(t):
    symbols = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").when(F.col("o_orderstatus") == "P", "A").alias("node"))
    return inventory.find_nodes(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("node")), symbols)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['cc', '-fsyntax-only', p_name, '-resource-dir', '/r', '-isysroot', '/s'] WHEN 1 THEN ['cc', '-fsyntax-only', '-x', p_name, '-resource-dir', '/r', '-isysroot', '/s', '-w']
WHEN 2 THEN ['cc', '-fsyntax-only', '-resource-dir', '/r', '-isysroot', '/s', '-w'] ELSE ['cc', '-fsyntax-only', '-weak', p_name, '-O2', '-resource-dir', '/r', '-isysroot', '/s'] END AS argv FROM part""")
def adjusted_commands(t):
    """Command lines without their outputs, checked only, with what the platform adds and a flag that some have already."""
    of = lambda *parts: F.array(*(F.col(p) if p == "p_name" else F.lit(p) for p in parts))
    n = F.col("p_partkey") % 4
    lines = F.when(n == 0, of("cc", "-c", "p_name", "-o", "-o", "-fsyntax-only")).when(n == 1, of("cc", "-x", "-oout", "p_name", "-c")).when(n == 2, of("cc", "-S", "-o")).otherwise(of("cc", "-weak", "p_name", "-o", "-c", "-O2"))
    added = argv.insert_arguments(["-w"], unless="-w")
    keeps = F.when(n == 0, argv.adjusted(lines, F.col("p_name"), argv.strip_output, argv.syntax_only, *argv.platform_flags("/r", "/s")))
    return t.part.select("p_partkey", keeps.otherwise(argv.adjusted(lines, F.col("p_name"), argv.strip_output, argv.syntax_only, *argv.platform_flags("/r", "/s"), added)).alias("argv"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 4) THEN 1 ELSE 0 END AS is_forwarding FROM part""")
def forwarding_parameters(t):
    """Which of six forms of a parameter forward, one of the template's names being the part's own."""
    forms = ["T &&", "const T &&", "int &&", "T &", "T&& ...", "std::vector<T> &&"]
    own = F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    spelled = F.replace(F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("T"), own)
    return t.part.select("p_partkey", text.is_forwarding(spelled, F.array(F.lit("U"), own)).alias("is_forwarding"))


@query(rf"""SELECT doc_id AS file, array_to_string(list_transform(regexp_extract_all(replace(text, ', ', ', NULL, '), '{TOKEN_SQL}'), lambda s: CASE WHEN s = 'NULL' THEN 'nullptr' ELSE s END), '') AS text FROM documents WHERE text IS NOT NULL""")
def null_literals(t):
    """Null constants of all texts are replaced where they are tokens, not where they are parts of strings or comments."""
    files = t.documents.where("text is not null").select(F.col("doc_id").alias("file"), F.replace("text", F.lit(", "), F.lit(", NULL, ")).alias("text"))
    return edits.rewrite(files, edits.null_literals(lexing.lexed(files, "file", "text")))


@query("SELECT 10 + row_number() OVER (ORDER BY path) AS id, path FROM (SELECT '/w/f' || p_partkey || '.c' AS path FROM part WHERE p_partkey <> 7) UNION ALL SELECT 10, '/none'")
def files_without_own(t):
    """Files in a registry, without the registry's own."""
    key = F.col("p_partkey").cast("string")
    found = t.part.select(F.concat(F.lit("/w/p"), key, F.lit("/../f"), key, F.lit(".c")).alias("path"))
    stored = t.spark.createDataFrame([(10, "/none", "/")], "id long, path string, owner string")
    roots = t.spark.createDataFrame([("/w",)], "root string")
    return registry.register_files(stored, found, roots, own_path="/w/f7.c").select("id", "path")


@query("SELECT o_orderkey, o_custkey, o_orderpriority || '?' AS marked FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority <> '1-URGENT'")
def bound_statement(t):
    """A statement with values bound to its markers; a mark in a string is none."""
    sql = f"SELECT o_orderkey, o_custkey, o_orderpriority || '?' AS marked FROM parquet.`{t.folder}/orders.parquet` WHERE o_orderstatus = ? AND o_totalprice > ? AND o_orderpriority <> ?"
    return statements.frame(t.spark, sql, "F", 200_000, "1-URGENT")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey >= l_partkey % 20 THEN l_partkey % 20 END AS \"offset\", CASE WHEN l_suppkey >= l_partkey % 20 THEN l_suppkey - l_partkey % 20 END AS size FROM lineitem")
def regions(t):
    """Regions from one place to another; none where the end lies before."""
    found = t.lineitem.select("l_orderkey", "l_linenumber", text.region(F.col("l_partkey") % 20, F.col("l_suppkey")).alias("r"))
    return found.select("l_orderkey", "l_linenumber", "r.offset", "r.size")
