"""Registered queries of the lesson operators: scopes, overriders, aliases, data flow, layout, labels, tokens, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.functions import text
from factfold.operators import lessons, match
from factfold.plans.registered import TOKEN_SQL, big, query


@query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE (l_returnflag = 'A' AND (l_linestatus = 'F' OR l_quantity > 40)) OR l_returnflag = 'R'")
def supported_declarations(t):
    kind = F.when(F.col("l_returnflag") == "A", "variable").when(F.col("l_returnflag") == "R", "method").otherwise("constructor")
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), kind.alias("kind"), (F.col("l_linestatus") == "F").alias("is_file_scope"), (F.col("l_quantity") > 40).alias("is_static_member"))
    return lessons.supported(rows).select("id")


@query("SELECT doc_id, text FROM documents WHERE source = (SELECT min(source) FROM documents)")
def main_file_rows(t):
    main = t.documents.agg(F.min("source")).first()[0]
    return lessons.main_file(t.documents.select("doc_id", "text", F.col("source").alias("file")), main).drop("file")


@query("SELECT c_custkey AS node, c_nationkey::BIGINT AS semantic_parent, CASE WHEN c_custkey % 3 = 0 THEN 100 + c_custkey % 7 ELSE c_nationkey END::BIGINT AS lexical_parent FROM customer")
def two_parents(t):
    meant = t.customer.select(big("c_nationkey").alias("source_id"), F.col("c_custkey").alias("destination_id"), F.lit(0).alias("is_lexical"))
    written = t.customer.where("c_custkey % 3 = 0").select((100 + F.col("c_custkey") % 7).alias("source_id"), F.col("c_custkey").alias("destination_id"), F.lit(1).alias("is_lexical"))
    return lessons.parents(meant.unionByName(written))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey > 0), w(method, overrider, d) AS (SELECT dst, src, 1 FROM e WHERE dst % 10 = 1 UNION ALL SELECT method, src, d + 1 FROM w JOIN e ON dst = overrider)
SELECT method, overrider, d::BIGINT AS distance FROM w""")
def overriders(t):
    edges = t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("source_id"), F.expr("c_custkey div 3").alias("destination_id"))
    return lessons.overriders(edges, t.customer.where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("method")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS alias, p_partkey // 2 AS target FROM part WHERE p_partkey % 5 <> 0), w(alias, target, hops) AS (SELECT alias, target, 1 FROM e UNION ALL SELECT w.alias, e.target, hops + 1 FROM w JOIN e ON w.target = e.alias)
SELECT alias, arg_max(target, hops) AS target, max(hops)::BIGINT AS hops FROM w GROUP BY 1""")
def alias_targets(t):
    return lessons.alias_targets(t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("alias"), F.expr("p_partkey div 2").alias("target")))


@query("SELECT o_orderkey AS instance, o_custkey AS template, CASE WHEN o_custkey % 4 = 0 THEN c_nationkey ELSE o_custkey END::BIGINT AS primary FROM orders JOIN customer ON o_custkey = c_custkey")
def instance_provenance(t):
    made = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("destination_id"), F.lit("Instantiates").alias("kind"))
    partial = t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("source_id"), big("c_nationkey").alias("destination_id"), F.lit("Specializes").alias("kind"))
    return lessons.provenance(made.unionByName(partial))


_INCLUDES = "SELECT c_custkey // 3 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey // 5, c_custkey FROM customer WHERE c_custkey > 0"


@query(f"WITH RECURSIVE e AS ({_INCLUDES}), w(node, d) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, d + 1 FROM w JOIN e ON src = node) SELECT node AS file, min(d)::BIGINT AS depth, min(d) = 1 AS is_direct FROM w WHERE node <> 0 GROUP BY 1")
def include_depths(t):
    one = lambda n: t.customer.where("c_custkey > 0").select(F.expr(f"c_custkey div {n}").alias("includer"), F.col("c_custkey").alias("includee"))
    return lessons.includes(one(3).unionByName(one(5)), 0)


@query("SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS canonical FROM orders")
def canonical_entities(t):
    return lessons.canonical(t.orders, ["o_custkey"], "o_orderkey")


@query("SELECT event_id AS id FROM events WHERE event_type = 'error' AND user_id % 3 <> 0")
def empty_statements(t):
    kind = F.when(F.col("event_type") == "error", "NullStmt").otherwise("CallExpr")
    return lessons.empty_statements(t.events.select(F.col("event_id").alias("id"), kind.alias("kind"), (F.col("user_id") % 3 == 0).alias("from_empty_macro")))


def _containment(t) -> DataFrame:
    """Regions hold nations, nations customers; suppliers stand below regions."""
    region = t.region.select(big("r_regionkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    nation = t.nation.select(big(F.col("n_nationkey") + 1000).alias("id"), big("n_regionkey").alias("parent_id"), F.when(F.col("n_nationkey") % 2 == 0, "attributed").otherwise("nation").alias("kind"), F.col("n_name").alias("name"))
    customer = t.customer.select((F.col("c_custkey") + 10_000_000).alias("id"), big(F.col("c_nationkey") + 1000).alias("parent_id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"))
    return region.unionByName(nation).unionByName(customer)


@query("SELECT c_custkey + 10000000 AS id, n_regionkey::BIGINT AS switch FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 1")
def buried_labels(t):
    return lessons.buried_labels(match.Tree(_containment(t)), "region", "customer", ["attributed"])


@query("""SELECT event_id AS id, event_type AS operator, CASE user_id % 4 WHEN 0 THEN 'built-in' WHEN 1 THEN 'built-in' WHEN 2 THEN 'overloaded' ELSE 'rewritten' END AS family FROM events WHERE event_id % 3 <> 0""")
def operator_nodes(t):
    by = F.col("user_id") % 4
    kind = F.when(F.col("event_id") % 3 == 0, "CallExpr").when(by == 0, "BinaryOperator").when(by == 1, "UnaryOperator").when(by == 2, "CXXOperatorCallExpr").otherwise("CXXRewrittenBinaryOperator")
    return lessons.operators(t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("operator"), kind.alias("kind")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 AND p_size % 5 <> 0 THEN CASE WHEN p_size > 25 THEN 'integer' ELSE 'none' END END AS kind, CASE WHEN p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size > 25 THEN p_size::VARCHAR END AS value FROM part")
def dependent_guard(t):
    size = F.col("p_size").cast("string")
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, size).otherwise(F.concat(F.lit("N + "), size)).alias("x"), (F.col("p_size") % 3 == 0).alias("is_type_dependent"), (F.col("p_size") % 5 == 0).alias("is_value_dependent"))
    return lessons.evaluated(rows, "x").select("p_partkey", F.col("constant.kind").alias("kind"), F.col("constant.value").alias("value"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'entity' WHEN o_custkey % 3 = 0 THEN 'pattern' WHEN o_custkey % 3 = 1 THEN 'instantiation' ELSE 'plain' END AS level, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def template_levels(t):
    only = lambda k: F.when(F.col("o_custkey") % 3 == k, F.col("o_custkey"))
    return lessons.template_levels(t.orders.select((F.col("o_orderstatus") == "F").alias("is_template"), only(0).alias("described_template"), only(1).alias("instantiated_from")))


_LAYOUT = """WITH RECURSIVE f AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, 8 * (1 << (p_size % 4)) AS a, 8 * (1 << (p_size % 4)) * (1 + p_size % 3) AS s FROM part),
r AS (SELECT p_brand, p_partkey, k, 0::BIGINT AS o, s::BIGINT AS e, a AS m FROM f WHERE k = 1 UNION ALL SELECT f.p_brand, f.p_partkey, f.k, (r.e + a - 1) // a * a, (r.e + a - 1) // a * a + s, greatest(m, a) FROM r JOIN f ON f.p_brand = r.p_brand AND f.k = r.k + 1)"""


def _fields(t) -> DataFrame:
    align = F.expr("8 * shiftleft(1, p_size % 4)")
    return t.part.select("p_brand", "p_partkey", align.alias("align"), (align * (1 + F.col("p_size") % 3)).alias("size"))


@query(f'{_LAYOUT} SELECT p_brand, p_partkey AS position, o AS "offset" FROM r')
def record_layout(t):
    """Offsets in bits of fields of 1 to 8 bytes' alignment."""
    return lessons.record_layout(_fields(t), "p_brand", "p_partkey", "size", "align")[0]


@query(f"{_LAYOUT} SELECT p_brand, (max(e) + max(m) - 1) // max(m) * max(m) AS size, max(m)::BIGINT AS alignment FROM r GROUP BY 1")
def record_sizes(t):
    return lessons.record_layout(_fields(t), "p_brand", "p_partkey", "size", "align")[1]


@query("SELECT o_orderkey AS id, target FROM orders JOIN (SELECT o_custkey AS c, o_orderpriority AS p, min(o_orderkey) AS target FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) ON c = o_custkey AND p = o_orderpriority WHERE o_orderstatus = 'F'")
def goto_edges(t):
    named = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("function"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    labels = named.where("o_orderstatus = 'O'").groupBy("function", "label").agg(F.min("id").alias("id"))
    return lessons.goto_edges(named.where("o_orderstatus = 'F'"), labels)


_FLOW = """e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation),
u AS (SELECT DISTINCT c_nationkey::BIGINT AS block, c_mktsegment AS variable FROM customer WHERE c_custkey % 5 = 0), d AS (SELECT DISTINCT c_nationkey::BIGINT AS block, c_mktsegment AS variable FROM customer WHERE c_custkey % 5 = 1)"""


def _flow(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    step = lambda x: t.nation.select(big("n_nationkey").alias("src"), big(x).alias("dst"))
    some = lambda k: t.customer.where(F.col("c_custkey") % 5 == k).select(big("c_nationkey").alias("block"), F.col("c_mktsegment").alias("variable")).distinct()
    return step((F.col("n_nationkey") * 7 + 3) % 25).unionByName(step((F.col("n_nationkey") + 1) % 25)), some(0), some(1)


@query(f"WITH RECURSIVE {_FLOW}, w AS (SELECT block, variable FROM u UNION SELECT e.src, w.variable FROM w JOIN e ON e.dst = w.block WHERE (e.src, w.variable) NOT IN (SELECT (block, variable) FROM d)) SELECT block, variable FROM w")
def live_variables(t):
    return lessons.live_in(*_flow(t))


@query(f"WITH RECURSIVE {_FLOW}, w AS (SELECT DISTINCT 0::BIGINT AS block, variable FROM u UNION SELECT e.dst, w.variable FROM w JOIN e ON e.src = w.block WHERE (w.block, w.variable) NOT IN (SELECT (block, variable) FROM d)) SELECT block, variable FROM u WHERE (block, variable) IN (SELECT (block, variable) FROM w)")
def uninitialised_values(t):
    edges, uses, defines = _flow(t)
    return lessons.uninitialised(edges, 0, uses, defines)


@query(rf"""SELECT doc_id, count(s) AS tokens, count(*) FILTER (WHERE s LIKE '//%' OR s LIKE '/*%') AS comments, count(*) FILTER (WHERE regexp_full_match(s, '[\p{{L}}_][\p{{L}}\p{{N}}_]*')) AS identifiers
FROM (SELECT doc_id, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS s FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{TOKEN_SQL}'), lambda s: NOT regexp_matches(s, '^[ \t\n\x0B\f\r]')) AS x FROM documents)) GROUP BY 1""")
def token_totals(t):
    return lessons.token_totals(t.documents, "doc_id", "text")


def _calls(t) -> match.Tree:
    """Orders are calls, their lines arguments by number, customers callees, nations the classes of these."""
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("call").alias("kind"), F.col("o_orderstatus").alias("name"))
    parts = t.part.select((F.col("p_partkey") + 10_000_000_000).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("value").alias("kind"), F.col("p_type").alias("name"))
    customers = t.customer.select((F.col("c_custkey") + 20_000_000_000).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("method").alias("kind"), F.col("c_mktsegment").alias("name"))
    nations = t.nation.select((F.col("n_nationkey") + 30_000_000_000).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("class").alias("kind"), F.col("n_name").alias("name"))
    edge = lambda df, a, b, kind, at: df.select(a.alias("source_id"), b.alias("destination_id"), F.lit(kind).alias("kind"), at.cast("int").alias("position"))
    arguments = edge(t.lineitem, F.col("l_orderkey"), F.col("l_partkey") + 10_000_000_000, "argument", F.col("l_linenumber"))
    callees = edge(t.orders, F.col("o_orderkey"), F.col("o_custkey") + 20_000_000_000, "callee", F.lit(0))
    classes = edge(t.customer, F.col("c_custkey") + 20_000_000_000, F.col("c_nationkey") + 30_000_000_000, "method_of", F.lit(0))
    parameters = edge(t.lineitem, F.col("l_orderkey"), F.col("l_suppkey"), "parameter", F.col("l_linenumber"))
    return match.Tree(orders.unionByName(parts).unionByName(customers).unionByName(nations), arguments.unionByName(callees).unionByName(classes).unionByName(parameters))


@query("""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_3' AND c_mktsegment = 'BUILDING'
AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND p_type = 'ECONOMY')""")
def call_matchers(t):
    """Calls with an economy part as second argument to a building method of another class than nation 3."""
    method = match.all_of(match.where("kind = 'method' and name = 'BUILDING'"), match.of_class(match.where("name <> 'NATION_3'")))
    return match.all_of(match.has_argument(2, match.where("name = 'ECONOMY'")), match.callee(method))(_calls(t))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 3")
def nth_parameter(t):
    return match.parameter_exists(3)(_calls(t))


@query("""SELECT c_custkey + 10000000 AS id, [n_regionkey, n_nationkey + 1000, c_custkey + 10000000]::BIGINT[] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey + 1000, [n_regionkey, n_nationkey + 1000]::BIGINT[] FROM nation UNION ALL SELECT r_regionkey, [r_regionkey]::BIGINT[] FROM region""")
def preorder(t):
    return match.preorder(match.Tree(_containment(t))).select("id", "path")


@query("""WITH n AS (SELECT c_custkey + 10000000 AS id, [n_regionkey, n_nationkey + 1000, c_custkey + 10000000]::BIGINT[] AS path, c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey + 1000, [n_regionkey, n_nationkey + 1000]::BIGINT[], n_name FROM nation UNION ALL SELECT r_regionkey, [r_regionkey]::BIGINT[], r_name FROM region)
SELECT id FROM n WHERE path <= (SELECT min(path) FROM n WHERE name = 'BUILDING')""")
def visit_until(t):
    return match.visit_until(match.Tree(_containment(t)), F.col("name") == "BUILDING").select("id")


@query("SELECT c_custkey + 10000000 AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def visible_nodes(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 10_000_000).alias("id"), (F.col("c_custkey") % 2 == 1).alias("is_implicit"), (F.col("c_custkey") % 3 == 0).alias("is_instantiation"))
    return match.visible(rows, instantiations=False).select("id")


@query("SELECT doc_id, strlen(left(text, 5)) AS byte_offset, substr(text, 6, 7) AS part FROM documents")
def byte_regions_of_all(t):
    """Regions in bytes of all texts, whatever their characters: those of the sixth to twelfth."""
    size = lambda n: F.octet_length(F.substr("text", F.lit(1), F.lit(n))).cast("long")
    rows = t.documents.select("doc_id", "text", size(5).alias("byte_offset"), (size(12) - size(5)).alias("size"))
    return rows.select("doc_id", "byte_offset", text.slice_bytes(F.col("text"), F.col("byte_offset"), F.col("size")).alias("part"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 7 = 4 THEN 'floating' ELSE 'integer' END AS kind,
  CASE l_linenumber % 7 WHEN 3 THEN (97 + l_suppkey % 26)::VARCHAR WHEN 4 THEN l_partkey || '.5e3' WHEN 5 THEN '10' WHEN 6 THEN '-' || (1000 + l_partkey % 1000) ELSE l_partkey::VARCHAR END AS value FROM lineitem""")
def literal_values(t):
    """Hexadecimal, suffixed, binary, character, floating and escaped literals, and marks between digits."""
    n, part = F.col("l_linenumber") % 7, F.col("l_partkey").cast("string")
    spelled = (
        F.when(n == 0, F.concat(F.lit("0x"), F.lower(F.hex("l_partkey")))).when(n == 1, F.concat(part, F.lit("ull"))).when(n == 2, F.concat(F.lit("0B"), F.bin("l_partkey"))).when(n == 3, F.concat(F.lit("L'"), F.char(97 + F.col("l_suppkey") % 26), F.lit("'")))
        .when(n == 4, F.concat(part, F.lit(".5e3f"))).when(n == 5, F.lit("'\\n'")).otherwise(F.concat(F.lit("-1'"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")))
    )
    found = text.constant(spelled)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found["kind"].alias("kind"), found["value"].alias("value"))


@query("SELECT doc_id, CASE WHEN length(text) >= 12 THEN decode(encode(text)[6:12]) ELSE '' END AS part FROM documents WHERE regexp_full_match(left(text, 12), '[ -~\\n]*')")
def byte_regions(t):
    """Seven bytes from the sixth on, of texts that begin in ASCII."""
    rows = t.documents.where(F.substr("text", F.lit(1), F.lit(12)).rlike("^[ -~\\n]*$"))
    return rows.select("doc_id", F.when(F.length("text") >= 12, text.slice_bytes(F.col("text"), F.lit(5), F.lit(7))).otherwise("").alias("part"))
