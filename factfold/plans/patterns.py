"""Registered queries of single look-ups, paths and commands, types and literals, matchers and lesson patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.functions import argv, flags, ids, paths, text
from factfold.operators import edits, graph, match, merge, resolve
from factfold.plans.registered import big, query

# look-ups and numbering ---------------------------------------------------------------------------------------------


@query("SELECT (l_orderkey << 32) | l_linenumber AS id, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F' GROUP BY 1")
def lookup_by_id_and_node(t):
    rows = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F"))
    return rows.groupBy(ids.pack_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("id")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_name LIKE 'NATION%'")
def in_list_prefix(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.where(F.col("r_name").isin("ASIA", "EUROPE") & F.col("n_name").startswith("NATION")).select("n_nationkey", "n_name", "r_name")


@query("SELECT o_orderpriority AS usr, o_custkey AS owner FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def global_owner(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("usr"), F.col("o_custkey").alias("owner"), "o_orderdate", "o_orderkey")
    return merge.first_sighting(rows, "usr", ["o_orderdate", "o_orderkey"]).select("usr", "owner")


@query("SELECT doc_id, generate_subscripts(w, 1)::BIGINT - 1 AS position, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def ordinal_position(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("position", "word")).withColumn("position", big("position"))


@query("""WITH p AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(n, 0) AS n, coalesce(parts, '') AS parts FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def load_facts(t):
    lists = t.lineitem.where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    whole = t.orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts"))
    return whole.select("o_orderkey", "o_custkey", "o_orderstatus", big(n).alias("n"), F.coalesce(F.array_join("parts", ","), F.lit("")).alias("parts"))


@query("SELECT l_orderkey, l_partkey, o_custkey, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'")
def fact_to_symbol(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_partkey", "o_custkey", "p_brand")


@query("SELECT o_orderpriority AS owner, count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS failures, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'P') AS first_failure FROM orders GROUP BY 1")
def failure_fold(t):
    bad = F.col("o_orderstatus") == "P"
    first = F.min_by(F.when(bad, F.col("o_orderkey")), F.when(bad, F.struct("o_orderdate", "o_orderkey")))
    return t.orders.groupBy(F.col("o_orderpriority").alias("owner")).agg(F.count("*").alias("total"), F.count_if(bad).alias("failures"), first.alias("first_failure"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, l_returnflag, l_linestatus LIMIT 3")
def top_groups(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(3)


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_algebra(t):
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return side("F").intersect(side("O")).subtract(side("P"))


# paths and commands -------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, '/work/' || p_brand || '/src' AS canonical, '/work/' || p_brand AS parent, CASE WHEN p_size > 25 THEN '.cpp' ELSE '' END AS extension,
  '<lib>/' || p_brand || '/src' AS portable FROM part""")
def path_functions(t):
    canonical = paths.normalise(F.concat(F.lit("./"), F.col("p_brand"), F.lit("/inc/../src//")), F.lit("/work"))
    name = F.concat(F.lit("/a/"), F.col("p_brand"), F.when(F.col("p_size") > 25, ".cpp").otherwise(""))
    return t.part.select(
        "p_partkey", canonical.alias("canonical"), paths.dirname(canonical).alias("parent"), paths.extension(name).alias("extension"),
        paths.portable(canonical, F.lit("/work"), F.lit("lib")).alias("portable"),
    )


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '/clone/' || p_brand || '/v' || p_size ELSE p_brand || '/v' || p_size END AS root FROM part")
def effective_root(t):
    return t.part.select("p_partkey", paths.effective_root(F.col("p_brand"), F.lit("/clone"), F.concat(F.lit("v"), F.col("p_size").cast("string")), F.col("p_size") > 25).alias("root"))


@query("SELECT p_partkey, '/opt/' || p_brand AS base, 'v' || p_size || '.1' AS version, p_size::BIGINT AS major FROM part")
def versioned_root(t):
    split = paths.split_version(F.concat(F.lit("/opt/"), F.col("p_brand"), F.lit("/v"), F.col("p_size").cast("string"), F.lit(".1")))
    return t.part.select("p_partkey", split.alias("s")).select("p_partkey", F.col("s.base").alias("base"), F.col("s.version").alias("version"), F.get(paths.version_key(F.col("s.version")), 0).alias("major"))


@query("SELECT p_partkey, p_brand || chr(31) || p_type AS key, CASE WHEN p_size > 25 THEN p_brand END AS name, CASE WHEN p_size > 25 THEN '/c/' || p_type END AS path FROM part")
def key_and_pair(t):
    pair = argv.name_and_path(F.concat(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.lit("=/c/"), F.col("p_type")))
    return t.part.select("p_partkey", argv.composite_key(F.col("p_brand"), F.col("p_type")).alias("key"), pair["name"].alias("name"), pair["path"].alias("path"))


@query("SELECT event_id, '[\"' || event_type || '\",\"a\\\"b\"]' AS encoded, true AS round_trip FROM events")
def options_json_encode(t):
    options = F.array(F.col("event_type"), F.lit('a"b'))
    return t.events.select("event_id", argv.encode_options(options).alias("encoded"), (argv.decode_options(argv.encode_options(options)) == options).alias("round_trip"))


# types, literals, regions -------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'floating' WHEN 2 THEN 'string' ELSE 'none' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_name END AS value FROM part""")
def constant_evaluation(t):
    which, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    literal = F.when(which == 0, size).when(which == 1, F.concat(size, F.lit(".5"))).when(which == 2, F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).otherwise("f(x)")
    return t.part.select("p_partkey", text.constant(literal).alias("c")).select("p_partkey", "c.kind", "c.value")


@query("SELECT c_custkey, [n_name, c_mktsegment, c_name] AS scopes, 'calls: ' || c_name || ' -> ' || n_name || ': -' AS message, greatest(c_custkey, c_nationkey)::BIGINT AS larger FROM customer JOIN nation ON c_nationkey = n_nationkey")
def usr_scopes(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.regexp_replace("c_name", "#", "/")
    usr = F.concat(F.lit("c:@N@"), F.col("n_name"), F.lit("@S@"), F.col("c_mktsegment"), F.lit("@F@"), name, F.lit("#I#"))
    scopes = F.transform(F.transform(text.usr_parts(usr), lambda x: F.regexp_replace(x, "^[NSF]@", "")), lambda x: F.replace(x, F.lit("/"), F.lit("#")))
    return rows.select("c_custkey", scopes.alias("scopes"), text.diagnostic(F.lit("calls"), F.col("c_name"), F.col("n_name"), F.lit("-")).alias("message"), big(text.scalar_max(F.col("c_custkey"), big("c_nationkey"))).alias("larger"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, text = '' AS is_empty, text LIKE '%e' AS ends_e, contains(text, ' la ') AS has_la, CASE WHEN text = '' THEN '?' ELSE text END AS shown FROM documents")
def text_regions(t):
    whole = text.slice_bytes(F.col("text"), F.lit(0), F.octet_length("text"))
    return t.documents.select(
        "doc_id", big(F.length(whole)).alias("chars"), big(F.octet_length("text")).alias("bytes"), (F.col("text") == "").alias("is_empty"), F.col("text").endswith("e").alias("ends_e"),
        F.col("text").contains(" la ").alias("has_la"), text.expression_text(F.col("text"), F.lit("?")).alias("shown"),
    )


# graphs and matchers ------------------------------------------------------------------------------------------------

_UP = "WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 0)"
_NODES = """WITH n AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, 'region' AS kind, r_name AS name FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey, 'nation', n_name FROM nation
  UNION ALL SELECT c_custkey + 10000000, c_nationkey + 1000, 'customer', c_mktsegment FROM customer)"""


def _tree(t) -> DataFrame:
    return t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst"))


def _nodes(t) -> match.Tree:
    region = t.region.select(big("r_regionkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    nation = t.nation.select(big(F.col("n_nationkey") + 1000).alias("id"), big("n_regionkey").alias("parent_id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    customer = t.customer.select((F.col("c_custkey") + 10_000_000).alias("id"), big(F.col("c_nationkey") + 1000).alias("parent_id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"))
    return match.Tree(region.unionByName(nation).unionByName(customer))


@query("SELECT l_suppkey AS dst, l_linenumber AS kind, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1, 2")
def reverse_edges(t):
    return t.lineitem.where(F.col("l_linenumber").isin(1, 2)).groupBy(F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("kind")).agg(F.count("*").alias("n"))


@query(f"{_UP}, c(src, dst) AS (SELECT src, dst FROM e UNION ALL SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src AS node, count(*)::BIGINT AS ancestors FROM c GROUP BY 1")
def scope_ancestors(t):
    return graph.depths(_tree(t).withColumnsRenamed({"src": "node", "dst": "parent"}))


@query("SELECT o_custkey AS usr, min(o_orderkey) AS canonical, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS definition, count(*)::BIGINT AS redeclarations FROM orders GROUP BY 1")
def redeclaration_chain(t):
    defined = F.col("o_orderstatus") == "F"
    hop = F.max_by(F.when(defined, F.col("o_orderkey")), F.when(defined, F.struct("o_orderdate", "o_orderkey")))
    return t.orders.groupBy(F.col("o_custkey").alias("usr")).agg(F.min("o_orderkey").alias("canonical"), hop.alias("definition"), F.count("*").alias("redeclarations"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, (7 * p_partkey + 3) % (SELECT count(*) FROM part) AS dst FROM part), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT src, dst FROM e WHERE src = dst OR (dst, src) IN (SELECT (src, dst) FROM c)""")
def back_edges(t):
    n = t.part.agg(F.count("*").alias("n"))  # one row
    edges = t.part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst"))
    return graph.cycle_edges(edges)


@query("""WITH RECURSIVE e AS (SELECT n_regionkey AS p, n_nationkey + 1000 AS node FROM nation UNION SELECT n_nationkey + 1000, 5000 + n_nationkey % 7 FROM nation UNION SELECT -1, r_regionkey FROM region),
r(node) AS (SELECT -1 UNION SELECT e.node FROM r JOIN e ON e.p = r.node),
w(gone, node) AS (SELECT r.node, -1 FROM r WHERE r.node <> -1 UNION SELECT w.gone, e.node FROM w JOIN e ON e.p = w.node WHERE e.node <> w.gone)
SELECT r.node::BIGINT AS node, d.node::BIGINT AS dominator FROM r, r AS d WHERE d.node = r.node OR d.node = -1 OR (d.node, r.node) NOT IN (SELECT (gone, node) FROM w)""")
def dominators(t):
    inner = t.nation.select(big("n_regionkey").alias("src"), big(F.col("n_nationkey") + 1000).alias("dst"))
    leaf = t.nation.select(big(F.col("n_nationkey") + 1000).alias("src"), big(F.lit(5000) + F.col("n_nationkey") % 7).alias("dst"))
    root = t.region.select(F.lit(-1).cast("long").alias("src"), big("r_regionkey").alias("dst"))
    return graph.dominators(inner.unionByName(leaf).unionByName(root), -1)


@query(f"{_NODES} SELECT a.id, a.name, p.name AS parent_name FROM n AS a JOIN n AS p ON a.parent_id = p.id WHERE a.kind = 'customer'")
def multi_bind(t):
    tree = _nodes(t)
    child = match.bind(tree, match.kind("customer"), "name", "parent_id")
    parent = tree.nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return child.join(parent, "parent_id").select("id", "name", "parent_name")


@query(f"{_NODES} SELECT id FROM n WHERE (kind = 'nation' OR name = 'BUILDING') AND parent_id NOT IN (SELECT id FROM n WHERE name = 'ASIA')")
def matcher_combinators(t):
    either = match.any_of(match.kind("nation"), match.where("name = 'BUILDING'"))
    return match.all_of(either, match.unless(match.has_parent(match.where("name = 'ASIA'"))))(_nodes(t))


@query(f"{_NODES} SELECT c.id FROM n AS c JOIN n AS p ON c.parent_id = p.id JOIN n AS r ON p.parent_id = r.id WHERE r.name = 'EUROPE' AND c.kind = 'customer'")
def has_ancestor(t):
    return match.all_of(match.kind("customer"), match.has_ancestor(match.where("name = 'EUROPE'")))(_nodes(t))


@query(f"{_NODES} SELECT c.id, r.id AS parent_id FROM n AS c JOIN n AS p ON c.parent_id = p.id JOIN n AS r ON p.parent_id = r.id UNION ALL SELECT id, parent_id FROM n WHERE kind = 'region'")
def spelled_in_source(t):
    tree = _nodes(t)
    return match.as_spelled(match.Tree(tree.nodes.withColumn("is_implicit", (F.col("kind") == "nation").cast("int")))).select("id", "parent_id")


@query(f"{_NODES} SELECT id FROM n WHERE kind = 'region' OR parent_id IN (SELECT id FROM n WHERE kind = 'region' AND name <> 'ASIA') AND kind = 'nation' OR parent_id IN (SELECT a.id FROM n AS a JOIN n AS b ON a.parent_id = b.id WHERE b.name <> 'ASIA') AND kind = 'customer'")
def pruned_traversal(t):
    tree = _nodes(t)
    return match.prune(tree, match.has_parent(match.where("name = 'ASIA'"))).select("id")


# lessons ------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS ctor, count(*)::BIGINT AS methods, count(*) FILTER (WHERE o_totalprice > 100000)::BIGINT AS fields, count(DISTINCT o_orderpriority)::BIGINT AS kinds FROM orders GROUP BY 1")
def class_summary(t):
    return t.orders.groupBy(F.col("o_custkey").alias("ctor")).agg(F.count("*").alias("methods"), F.count_if(F.col("o_totalprice") > 100000).alias("fields"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS error, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS click FROM events GROUP BY 1")
def check_counters(t):
    return t.events.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "click")))


@query("""SELECT doc_id AS file, string_agg(CASE WHEN w IN ('la', 'le') THEN 'X' ELSE w END, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY 1""")
def rename_edits(t):
    words = F.split("text", " ")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    step = lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.when(w.isin("la", "le"), F.array_append(s["hits"], s["at"])).otherwise(s["hits"]).alias("hits"))
    files = t.documents.select(F.col("doc_id").alias("file"), "text")
    found = files.select("file", F.explode(F.aggregate(words, start, step)["hits"]).alias("offset"))
    return edits.rewrite(files, found.select("file", "offset", F.lit(2).alias("length"), F.lit("X").alias("text")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount > 0.02")
def missing_override(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "A").cast("int").alias("overrides"), (F.col("l_linestatus") != "F").cast("int").alias("is_override"), (F.col("l_discount") > 0.02).cast("int").alias("has_body"))
    return edits.missing_override(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderpriority AS src, o_orderstatus AS via, CASE o_orderstatus WHEN 'F' THEN 'static_cast' WHEN 'O' THEN 'reinterpret_cast' ELSE 'keep' END AS named, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""")
def cast_inventory(t):
    named = flags.classify(F.col("o_orderstatus"), {"static_cast": ["F"], "reinterpret_cast": ["O"]}, "keep")
    return t.orders.groupBy(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("via"), named.alias("named")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size > 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber > 5)")
def magic_numbers(t):
    substituted = t.lineitem.where("l_returnflag = 'N' AND l_linenumber > 5").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.where("p_size > 40").select("p_partkey").join(substituted, "p_partkey", "left_anti")


@query("SELECT o_custkey AS owner, o_orderpriority AS position, max((o_totalprice > 200000)::INT) AS has_default FROM orders GROUP BY 1, 2")
def default_over_chain(t):
    return merge.merge(t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("position"), (F.col("o_totalprice") > 200000).cast("int").alias("has_default"), "o_orderkey"), ["owner", "position"], {"has_default": "or"}, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 2 AND p_brand = 'Brand#2' GROUP BY 1, 2")
def specialisation_by_argument(t):
    second = t.lineitem.where("l_linenumber = 2").join(t.part.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    return second.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS function_id, count(*)::BIGINT AS temporaries FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def temporaries_per_function(t):
    rows = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("function_id")).agg(F.count("*").alias("temporaries"))


@query("""SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN NULL ELSE 'no owner: ' || doc_id END AS error FROM documents""")
def lookup_or_fail(t):
    good, bad = resolve.lookup_or_fail(t.documents.select("doc_id", "lang"), t.labels.select("doc_id").distinct(), "doc_id")
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS file, l_orderkey * 100 + l_suppkey AS g, (l_partkey % 500)::BIGINT AS "offset", (l_quantity % 5)::BIGINT AS length FROM lineitem),
r AS (SELECT *, coalesce(("offset" < max("offset" + length) OVER (PARTITION BY file ORDER BY "offset", length, lpad(g::VARCHAR, 12, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS rejected FROM e)
SELECT file, "offset", length, g FROM r WHERE g NOT IN (SELECT g FROM r WHERE rejected = 1)""")
def atomic_commit(t):
    """Edits of a file in groups; most groups survive, and those with an edit that overlaps go whole."""
    g = F.col("l_orderkey") * 100 + F.col("l_suppkey")
    e = t.lineitem.select(F.col("l_orderkey").alias("file"), big(F.col("l_partkey") % 500).alias("offset"), big(F.col("l_quantity") % 5).alias("length"), F.lpad(g.cast("string"), 12, "0").alias("text"), g.alias("g"))
    return edits.commit_groups(e.distinct(), "g").select("file", "offset", "length", "g")


@query("""WITH f(i, spelled, p, l, r, k) AS (VALUES (0, 'const T *', 1, 0, 0, 1), (1, 'T &', 0, 1, 0, 0), (2, 'T &&', 0, 0, 1, 0), (3, 'T', 0, 0, 0, 0), (4, 'T *const', 1, 0, 0, 1), (5, 'T[8]', 1, 0, 0, 0), (6, 'volatile T * &', 0, 1, 0, 0), (7, 'const T &', 0, 1, 0, 1), (8, 'T **', 1, 0, 0, 0))
SELECT p_partkey, p_type AS innermost, p AS is_pointer, l AS is_lvalue_reference, r AS is_rvalue_reference, k AS is_const FROM part JOIN f ON i = p_partkey % 9""")
def type_peel_flags(t):
    forms = ["const T *", "T &", "T &&", "T", "T *const", "T[8]", "volatile T * &", "const T &", "T **"]
    spelled = F.replace(F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 9 + 1).cast("int")), F.lit("T"), F.col("p_type"))
    shown = t.part.select("p_partkey", text.peel(spelled).alias("innermost"), *text.type_flags(spelled))
    return shown.select("p_partkey", "innermost", "is_pointer", "is_lvalue_reference", "is_rvalue_reference", "is_const")
