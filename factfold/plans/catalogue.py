"""All registered queries of the library, each with the SQL that states the same result.

The driver's tables stand in for fact tables: orders of a customer are sightings of a symbol, lineitems are edges between
orders, parts and suppliers, nations and regions form a containment tree, documents and pages are source texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.functions import argv, flags, ids, paths, text
from factfold.operators import allocate, edits, graph, match, merge, resolve, validate
from factfold.plans import analysis, extraction, language, lessons, migration, patterns, projects  # noqa: F401  register their queries
from factfold.plans.registered import ORACLE_SQL, QUERIES, TOKEN_SQL, big, query  # noqa: F401

# filters, scalars ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O') AND o_orderkey >= 100")
def scan_filter_project(t):
    o = t.orders.where((F.col("o_totalprice") >= 100000) & F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderkey") >= 100))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT (l_orderkey << 32) | l_linenumber AS id, ((l_orderkey << 32) | l_linenumber) >> 32 AS file_id, l_linenumber::BIGINT AS idx FROM lineitem")
def pack_unpack_id(t):
    packed = ids.pack_id(F.col("l_orderkey"), F.col("l_linenumber"))
    return t.lineitem.select(packed.alias("id")).select("id", ids.file_of(F.col("id")).alias("file_id"), ids.index_of(F.col("id")).alias("idx"))


@query("""SELECT o_orderkey, CASE o_orderkey & 3 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' ELSE 'none' END AS access,
  ((o_orderkey >> 2) & 1)::INT AS is_definition, ((o_orderkey >> 4) & 1)::INT AS is_static, ((o_orderkey >> 6) & 1)::INT AS is_const FROM orders""")
def flag_decode(t):
    f = F.col("o_orderkey")
    return t.orders.select("o_orderkey", flags.field(f, 0, 2, ["public", "protected", "private", "none"]).alias("access"), *flags.decode(f, {"is_definition": 2, "is_static": 4, "is_const": 6}))


@query("SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END + CASE WHEN o_totalprice > 50000 THEN 16 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 64 ELSE 0 END)::BIGINT AS flags FROM orders")
def flag_encode(t):
    bits = [(F.col("o_orderstatus") == "F", 2), (F.col("o_totalprice") > 50000, 4), (F.col("o_orderpriority") == "1-URGENT", 6)]
    return t.orders.select("o_orderkey", big(flags.encode(bits)).alias("flags"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'reference' WHEN event_type = 'error' THEN 'diagnostic' ELSE 'declaration' END AS node FROM events")
def kind_classify(t):
    return t.events.select("event_id", flags.classify(F.col("event_type"), {"reference": ["click", "view"], "diagnostic": ["error"]}, "declaration").alias("node"))


@query("SELECT p_partkey, CASE WHEN p_size >= 20 THEN p_size + 1 ELSE p_size END AS kind FROM part")
def kind_renumber(t):
    return t.part.select("p_partkey", flags.renumber(F.col("p_size"), 20, 1).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'usr:' || p_name ELSE 'decl:' || p_name || ':' || p_size || ':' || p_partkey || ':' || (p_partkey % 7) END AS identity FROM part")
def symbol_identity(t):
    usr = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise("")
    return t.part.select("p_partkey", ids.identity(usr, F.col("p_name"), F.col("p_size"), F.col("p_partkey"), F.col("p_partkey") % 7).alias("identity"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props LIKE '[%' AS is_list FROM events")
def options_json_decode(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), argv.decode_options(F.col("props")).isNotNull().alias("is_list"))



@query(r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS base FROM pages")
def url_path_split(t):
    path = F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    return t.pages.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), path.alias("path"), paths.basename(path).alias("base"))


@query("""SELECT doc_id, o AS "offset", length(left(text, o)) - length(replace(left(text, o), chr(10), '')) + 1 AS line, length(string_split(left(text, o), chr(10))[-1]) + 1 AS col
FROM (SELECT doc_id, text, unnest([0, doc_id % 50, length(text) // 3, length(text) // 2, length(text)]) AS o FROM documents) WHERE o <= length(text)""")
def offset_line_column(t):
    """Places inside the texts: their begins, two in the midst, ends."""
    size = big(F.length("text"))
    spots = t.documents.select("doc_id", "text", F.explode(F.array(F.lit(0).cast("long"), F.col("doc_id") % 50, F.floor(size / 3), F.floor(size / 2), size)).alias("offset")).where(F.col("offset") <= F.length("text"))
    return spots.select("doc_id", "offset", big(text.line_of(F.col("text"), F.col("offset"))).alias("line"), big(text.column_of(F.col("text"), F.col("offset"))).alias("col"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND regexp_matches(p_brand, '^Brand#[0-9]*$')")
def name_search(t):
    return t.part.where(text.like_ascii(F.col("p_name"), "%A%") & text.glob(F.col("p_brand"), "Brand#*")).select("p_partkey", "p_name")


@query("SELECT l_orderkey, count(*) FILTER (WHERE (l_linenumber & 1) <> 0)::BIGINT AS with_role, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def role_filter(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(resolve.has_role(F.col("l_linenumber"), 1)).alias("with_role"), F.count("*").alias("n"))


# merge and writes ---------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order,
  max((o_totalprice > 200000)::INT) AS is_definition, min((o_totalprice > 20000)::INT) AS is_external,
  coalesce(arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'P'), 'P') AS access, count(*)::BIGINT AS sightings FROM orders GROUP BY 1)
SELECT *, (((o_custkey % 16) + 1) << 32) | (row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY first_order) - 1) AS id FROM m""")
def merge_symbol_versions(t):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderkey").alias("last_order"), (F.col("o_totalprice") > 200000).cast("int").alias("is_definition"), (F.col("o_totalprice") > 20000).cast("int").alias("is_external"), F.col("o_orderstatus").alias("access"), F.lit(1).alias("sightings"))
    rules = {"first_order": "first", "last_order": "last", "is_definition": "or", "is_external": "and", "access": "last_but:P", "sightings": "count"}
    merged = merge.merge(rows, ["o_custkey"], rules, ["o_orderdate", "o_orderkey"])
    numbered = allocate.sequence(merged.withColumn("file_id", F.col("o_custkey") % 16 + 1), "file_id", ["first_order"])
    return numbered.withColumn("id", ids.pack_id(F.col("file_id"), F.col("index"))).drop("file_id", "index")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, arg_max(o_totalprice, o_orderkey) AS last_price, max((o_orderstatus = 'F')::INT) AS is_definition FROM orders GROUP BY 1")
def merge_incremental(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("last_price"), (F.col("o_orderstatus") == "F").cast("int").alias("is_definition"))
    rules, half = {"first_order": "first", "last_price": "last", "is_definition": "or"}, t.orders.agg(F.max("o_orderkey") / 2).alias("h")
    mark = rows.crossJoin(F.broadcast(half.toDF("half")))  # one row
    old, new = mark.where("o_orderkey < half").drop("half"), mark.where("o_orderkey >= half").drop("half")
    return merge.merge_into(merge.merge(old, ["o_custkey"], rules, ["o_orderkey"]), new, ["o_custkey"], rules, ["o_orderkey"])


@query("SELECT user_id, event_type, max((value > 20)::INT) AS has_default, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def sticky_default(t):
    rows = t.events.select("user_id", "event_type", "event_id", (F.col("value") > 20).cast("int").alias("has_default"), F.col("value").alias("last_value"))
    return merge.merge(rows, ["user_id", "event_type"], {"has_default": "or", "last_value": "last"}, ["event_id"])


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def insert_ignore_edges(t):
    return merge.insert_ignore(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("""WITH r AS (SELECT conv_id // 10 AS fn, conv_id AS version, turn, length(text) AS size, (length(text) > 200)::INT AS has_default FROM conversations),
a AS (SELECT fn, arg_max(n, version) AS arity FROM (SELECT fn, version, max(turn) + 1 AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT fn, turn, arg_max(size, version) AS size, max(has_default) AS has_default FROM r JOIN a USING (fn) WHERE turn < arity GROUP BY 1, 2""")
def param_replace_trim(t):
    rows = t.conversations.select(F.floor(F.col("conv_id") / 10).alias("fn"), F.col("conv_id").alias("version"), "turn", F.length("text").cast("long").alias("size"), (F.length("text") > 200).cast("int").alias("has_default"))
    return merge.replace_parameters(rows, "fn", "turn", "version", "has_default").select("fn", "turn", "size", "has_default")


@query("SELECT event_type, user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def replace_sink(t):
    return merge.last_wins(t.events.select("event_type", "user_id", "value", "event_id"), ["event_type", "user_id"], ["event_id"])


# numbering ----------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS index FROM orders")
def allocate_file_sequence(t):
    return allocate.sequence(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, count(*)::BIGINT AS next_index FROM orders GROUP BY 1")
def allocator_next_index(t):
    return allocate.next_index(allocate.sequence(t.orders, "o_custkey", ["o_orderkey"]), "o_custkey", "index")


@query("""WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index, o_orderkey FROM orders)
SELECT o_custkey, count(*)::BIGINT AS n, max(index) + 1 AS next_index, (count(*) = max(index) + 1 AND min(index) = 0)::INT AS is_dense FROM s WHERE o_orderkey % 7 <> 0 GROUP BY 1""")
def sequence_density(t):
    """Numbers of which some rows have gone."""
    numbered = allocate.sequence(t.orders, "o_custkey", ["o_orderkey"])
    return allocate.density(numbered.where("o_orderkey % 7 <> 0"), "o_custkey", "index")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderkey % 3 <> 0),
m AS (SELECT o_custkey, max(index) + 1 AS nxt FROM s GROUP BY 1)
SELECT *, (o_custkey << 32) | index AS id FROM (SELECT * FROM s UNION ALL SELECT o_custkey, o_orderkey, coalesce(nxt, 0) + k FROM n LEFT JOIN m USING (o_custkey))""")
def incremental_allocate(t):
    o = t.orders.select("o_custkey", "o_orderkey")
    stored = allocate.sequence(o.where("o_orderkey % 3 = 0"), "o_custkey", ["o_orderkey"])
    return allocate.allocate(stored, o, "o_custkey", "o_orderkey", ["o_orderkey"])


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def next_token(t):
    return t.conversations.select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@query("SELECT event_id, user_id, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM events")
def running_depth(t):
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return t.events.select("event_id", "user_id", F.sum(step).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def enclosing_section(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before > o_totalprice""")
def order_inversion(t):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.withColumn("before", before).where("before > o_totalprice").select("o_orderkey", "o_custkey")


# joins --------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name AS source_name, r_name AS target_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def edge_resolution(t):
    symbols = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name")).unionByName(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name")))
    e = t.nation.select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    return resolve.resolve_edges(e, symbols, "src", "dst", "id", "name").select("n_nationkey", "source_name", "target_name")


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def optional_type_left_join(t):
    types = t.nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(types, "c_nationkey", "left").select("c_custkey", "c_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity, r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 45")
def component_path_join(t):
    rows = t.lineitem.where("l_quantity > 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "c_name", F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS dflt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, n, dflt FROM p LEFT JOIN d USING (l_orderkey, l_linenumber)""")
def composite_left_join(t):
    p = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    d = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("dflt"))
    return p.join(d, ["l_orderkey", "l_linenumber"], "left")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_in(t):
    return t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def semi_exists_both(t):
    key = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(key("R"), "o_orderkey", "left_semi").join(key("A"), "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(t):
    return t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49 AND o_orderstatus = 'F')")
def exists_over_join(t):
    inner = t.orders.where("o_orderstatus = 'F'").join(t.lineitem.where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(inner, "c_custkey", "left_semi")


@query("SELECT o_orderkey, 'l_orderkey' AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def dangling_edges(t):
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").withColumn("missing", F.lit("l_orderkey"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_partkey' AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_suppkey' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def dangling_ends(t):
    """Edges either end of which is no symbol."""
    return resolve.dangling(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), t.supplier, "l_partkey", "l_suppkey", "s_suppkey")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_containment(t):
    return validate.contained(t.documents.select("doc_id"), t.labels.select("doc_id"))


@query(r"""WITH f AS (SELECT page_id, regexp_extract(url, '^https?:/(/[^?#]*)', 1) AS path FROM pages), r AS (SELECT DISTINCT regexp_extract(path, '^(/[^/]+(?:/[^/]+)?)', 1) AS root FROM f WHERE page_id % 3 = 0)
SELECT page_id, path, (SELECT arg_max(root, length(root)) FROM r WHERE path = root OR starts_with(path, root || '/')) AS owner FROM f""")
def longest_prefix_owner(t):
    files = t.pages.select("page_id", F.regexp_extract("url", "^https?:/(/[^?#]*)", 1).alias("path"))
    roots = files.where("page_id % 3 = 0").select(F.regexp_extract("path", "^(/[^/]+(?:/[^/]+)?)", 1).alias("root")).distinct()
    return resolve.longest_prefix_owner(files, "path", roots, "root").select("page_id", "path", "owner")


@query("SELECT user_id, coalesce(a.v, b.v) AS v FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, min(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1) b USING (user_id)")
def preferred_map_merge(t):
    one = lambda kind, f: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(f("value").alias("v"))
    return resolve.preferred(one("click", F.max), one("error", F.min), "user_id", "v")


@query("SELECT o_orderkey, o_custkey, c_name, (o_orderstatus = 'F')::INT AS is_write FROM orders JOIN customer ON o_custkey = c_custkey")
def find_references(t):
    uses = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("is_write"))
    return resolve.references(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), uses, "o_custkey")


@query("""WITH s AS (SELECT (1::BIGINT << 32) | (row_number() OVER (ORDER BY p_brand) - 1) AS id, p_brand AS usr FROM (SELECT DISTINCT p_brand FROM part)), w AS (SELECT DISTINCT p_type AS usr FROM part)
SELECT id, usr, 0 AS is_external FROM s UNION ALL SELECT (1::BIGINT << 32) | ((SELECT count(*) FROM s) + row_number() OVER (ORDER BY usr) - 1), usr, 1 FROM w WHERE usr NOT IN (SELECT usr FROM s)""")
def lookup_or_insert(t):
    brands = allocate.sequence(t.part.select(F.col("p_brand").alias("usr")).distinct().withColumn("f", F.lit(1).cast("long")), "f", ["usr"])
    zero = F.lit(0)
    symbols = brands.select(ids.pack_id(F.col("f"), F.col("index")).alias("id"), "usr", zero.alias("is_external"), zero.alias("line"), zero.alias("col"), zero.alias("offset"))
    return resolve.lookup_or_insert(t.part.select(F.col("p_type").alias("usr")), symbols, 1).select("id", "usr", "is_external")


# groups -------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_usr(t):
    return validate.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT text, min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents GROUP BY 1")
def deterministic_winner(t):
    return resolve.deterministic_winner(t.documents.select("text", "doc_id"), ["text"], ["doc_id"])


@query("""SELECT p_brand AS name, arg_max('/opt/' || p_brand || '/v' || (p_size // 10) || '.' || (p_size % 10 + 5), (p_size // 10, p_size % 10 + 5)) AS root FROM part GROUP BY 1""")
def version_max(t):
    root = F.concat(F.lit("/opt/"), F.col("p_brand"), F.lit("/v"), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10 + 5).cast("string"))
    return resolve.newest_version(t.part.select(F.col("p_brand").alias("name"), root.alias("path")), "name", "path")


@query("SELECT lang, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS size FROM documents GROUP BY 1")
def argmax_longest(t):
    return t.documents.groupBy("lang").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"), F.max(F.length("text")).cast("long").alias("size"))


@query("""WITH f AS (SELECT p_brand, '/src/' || p_type || CASE WHEN p_size % 2 = 0 THEN '/even/' ELSE '/odd/' END || p_partkey AS path FROM part),
d AS (SELECT p_brand, regexp_replace(path, '/[^/]*$', '') AS dir FROM f),
p AS (SELECT DISTINCT p_brand, unnest(['', '/src', regexp_extract(dir, '^(/src/[^/]*)', 1), dir]) AS prefix FROM d)
SELECT p_brand, arg_max(prefix, length(prefix)) AS root FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.p_brand = p.p_brand AND dir <> prefix AND NOT starts_with(dir, prefix || '/')) GROUP BY 1""")
def common_root(t):
    """The directory that the files of each brand have in common."""
    path = F.concat(F.lit("/src/"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "/even/").otherwise("/odd/"), F.col("p_partkey").cast("string"))
    directories = t.part.select("p_brand", paths.dirname(path).alias("path"))
    return directories.groupBy("p_brand").agg(paths.common_root(F.min("path"), F.max("path")).alias("root"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS owners, count(DISTINCT o_orderstatus)::BIGINT AS kinds FROM orders")
def distinct_summary(t):
    return t.orders.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("owners"), F.count_distinct("o_orderstatus").alias("kinds"))


@query("SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_custkey").alias("key")).union(t.orders.select("o_custkey")).union(t.supplier.select("s_suppkey")).distinct()


@query("SELECT o_orderkey, o_custkey, 'removed' AS side FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'added' FROM orders WHERE o_orderkey % 50 = 7")
def snapshot_diff(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    return validate.snapshot_diff(o.where("o_orderkey % 50 <> 7"), o.where("o_orderkey % 100 <> 0"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS parameters FROM orders GROUP BY 1")
def ordered_list(t):
    return t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("parameters"))


@query(rf"""SELECT s AS spelling, count(*)::BIGINT AS n, bool_or(regexp_matches(s, '^\.?[0-9]')) AS has_digits FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS s FROM documents)
WHERE regexp_matches(s, '^\.?[0-9]') OR regexp_full_match(s, '[\p{{L}}_][\p{{L}}\p{{N}}_]*') GROUP BY 1""")
def token_inventory(t):
    kind = text.token_kind(F.col("spelling"))
    spelled = t.documents.select(F.explode(text.tokens(F.col("text"))).alias("spelling")).where(kind.isin("number", "identifier"))
    return spelled.groupBy("spelling").agg(F.count("*").alias("n"), F.bool_or(kind == "number").alias("has_digits"))


@query(rf"""SELECT s AS spelling, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS s FROM documents) WHERE regexp_full_match(s, '[\p{{L}}_][\p{{L}}\p{{N}}_]*') GROUP BY 1 ORDER BY n DESC, spelling LIMIT 5""")
def top_identifiers(t):
    spelled = t.documents.select(F.explode(text.tokens(F.col("text"))).alias("spelling")).where(text.token_kind(F.col("spelling")) == "identifier")
    return spelled.groupBy("spelling").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spelling").limit(5)


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS includee FROM pages""")
def include_graph(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("includee"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS out_degree FROM pages""")
def out_degree(t):
    e = t.pages.select("page_id", F.explode_outer(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("to"))
    return e.groupBy("page_id").agg(F.count("to").alias("out_degree"))


@query("SELECT event_type AS kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 30)::BIGINT AS large FROM events GROUP BY 1")
def kind_inventory(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 30).alias("large"))


@query("SELECT event_id, user_id, 'read' AS family FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT event_id, user_id, 'fault' FROM events WHERE event_type = 'error'")
def union_kinds(t):
    e = t.events.select("event_id", "user_id", "event_type")
    return e.where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", F.lit("read").alias("family")).unionByName(e.where("event_type = 'error'").select("event_id", "user_id", F.lit("fault").alias("family")))


@query("SELECT o_custkey, o_orderdate::DATE AS day, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def multi_declarator(t):
    return t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_custkey, o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT o_custkey, o_orderpriority FROM orders")
def missing_case(t):
    return edits.missing_cases(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "c_custkey", "o_orderpriority")


# graphs -------------------------------------------------------------------------------------------------------------

_TREE = "SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 0"
_UP = f"WITH RECURSIVE e AS ({_TREE}), c(src, dst, d) AS (SELECT src, dst, 1 FROM e UNION SELECT c.src, e.dst, c.d + 1 FROM c JOIN e ON c.dst = e.src)"


def _tree(t) -> DataFrame:
    return t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst"))


@query(f"{_UP} SELECT src, dst, d AS distance FROM c")
def derived_closure(t):
    return graph.closure(_tree(t))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS dst FROM part), r(node) AS (SELECT 2::BIGINT UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r")
def reachable(t):
    return graph.reachable(_functional(t), t.spark.createDataFrame([(2,)], "node long")).select("node")


def _functional(t) -> DataFrame:
    n = t.part.agg(F.count("*").alias("n"))
    return t.part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % F.col("n")).alias("dst"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS dst FROM part), r(node) AS (SELECT 2::BIGINT UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def unreachable(t):
    return graph.unreachable(t.part.select(F.col("p_partkey").alias("node")), _functional(t), t.spark.createDataFrame([(2,)], "node long"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS dst FROM part), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src AS node FROM c WHERE src = dst AND src IN (SELECT p_partkey FROM part)")
def cycle_nodes(t):
    return graph.cycle_nodes(_functional(t))


@query("SELECT s_nationkey AS caller, c_nationkey AS callee, count(*)::BIGINT AS calls FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def call_graph(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("s_nationkey").alias("caller"), F.col("c_nationkey").alias("callee")).agg(F.count("*").alias("calls"))


@query(f"{_UP} SELECT dst AS node, max(d)::BIGINT AS level FROM c GROUP BY 1 UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT dst FROM c)")
def topological_levels(t):
    return graph.levels(_tree(t)).select("node", big("level").alias("level"))


@query(f"{_UP} SELECT src AS node, arg_min(dst, d) AS ancestor, min(d)::BIGINT AS distance FROM c WHERE dst IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def nearest_ancestor(t):
    tree = _tree(t)
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.nearest_ancestor(tree.withColumnsRenamed({"src": "node", "dst": "parent"}), wanted).select("node", "ancestor", big("distance").alias("distance"))


def _containment(t) -> match.Tree:
    region = t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    nation = t.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    customer = t.customer.select((F.col("c_custkey") + 10_000_000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent_id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"))
    return match.Tree(region.unionByName(nation).unionByName(customer))


@query("SELECT n_nationkey + 1000 AS id FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING')")
def has_child(t):
    tree = _containment(t)
    return match.all_of(match.kind("nation"), match.has(match.where("name = 'BUILDING'")))(tree)


@query("SELECT r_regionkey::BIGINT AS id FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_mktsegment = 'BUILDING')")
def has_descendant(t):
    return match.all_of(match.kind("region"), match.has_descendant(match.where("name = 'BUILDING'")))(_containment(t))


@query("SELECT n_regionkey::BIGINT AS ancestor, c_custkey + 10000000 AS descendant, 2::BIGINT AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
def foreach_descendant(t):
    out = match.for_each_descendant(_containment(t), match.kind("region"), match.where("name = 'MACHINERY'"))
    return out.select("ancestor", "descendant", big("distance").alias("distance"))


@query("SELECT c_custkey + 10000000 AS id, n_regionkey::BIGINT AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jump_target(t):
    return match.jump_targets(_containment(t), {"customer": ["region"]})


# edits, lint, integrity ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def virtual_without_dtor(t):
    key = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("o_orderkey"))
    return edits.with_and_without(t.orders.select("o_orderkey"), key("R"), key("A"), "o_orderkey")


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 4")
def too_many_params(t):
    return edits.too_many(t.lineitem, "l_orderkey", 4)


@query("SELECT DISTINCT source AS file, n_chars AS \"offset\", lang AS \"check\" FROM documents")
def finding_dedup(t):
    return edits.findings_once(t.documents.select(F.col("source").alias("file"), F.col("n_chars").alias("offset"), F.col("lang").alias("check")))


@query("""WITH e AS (SELECT l_orderkey AS file, (l_partkey % 500)::BIGINT AS "offset", l_quantity::BIGINT AS length, count(*) AS c FROM lineitem GROUP BY 1, 2, 3)
SELECT file, "offset", length, coalesce(("offset" < max("offset" + length) OVER (PARTITION BY file ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS rejected FROM e""")
def overlap_rejection(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("file"), big(F.col("l_partkey") % 500).alias("offset"), big("l_quantity").alias("length"), F.lit("").alias("text"))
    return edits.overlaps(edits.deduplicate(e)).drop("text")


@query("SELECT doc_id AS file, CASE WHEN length(text) >= 10 THEN '/*' || substr(text, 1, 3) || '<' || substr(text, 7) ELSE text END AS text FROM documents")
def apply_edits(t):
    files = t.documents.select(F.col("doc_id").alias("file"), "text")
    edit = lambda offset, length, new: files.where(F.length("text") >= 10).select("file", F.lit(offset).alias("offset"), F.lit(length).alias("length"), F.lit(new).alias("text"))
    return edits.rewrite(files, edit(0, 0, "/*").unionByName(edit(3, 3, "<")).unionByName(edit(3, 3, "<")).unionByName(edit(4, 1, "?")))


@query("""SELECT 'orders' AS child, 'o_custkey' AS column_name, 'customer' AS parent, count(*)::BIGINT AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels', 'doc_id', 'documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents', 'doc_id', 'labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def fk_check(t):
    keys = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]
    return validate.fk_violations({n: getattr(t, n) for n in ("orders", "customer", "lineitem", "labels", "documents")}, keys)


@query("""SELECT 'status' AS check_name, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))::BIGINT AS violations FROM orders
UNION ALL SELECT 'price', count(*) FILTER (WHERE NOT o_totalprice >= 1000)::BIGINT FROM orders""")
def check_domains(t):
    return validate.domain_violations(t.orders, {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") >= 1000})


@query("""SELECT 'customer' AS name, c_custkey AS key FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3
UNION ALL SELECT 'lineitem', l_orderkey * 1000 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3""")
def cascade_delete(t):
    """Customers of a nation go, and with them their orders and the lines of these."""
    keys = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    left = validate.cascade_delete({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, t.customer.where("c_nationkey = 3").select("c_custkey"), keys, "customer", "c_custkey")
    rows = lambda n, c: left[n].select(F.lit(n).alias("name"), c.alias("key"))
    return rows("customer", F.col("c_custkey")).unionByName(rows("orders", F.col("o_orderkey"))).unionByName(rows("lineitem", F.col("l_orderkey") * 1000 + F.col("l_linenumber")))
