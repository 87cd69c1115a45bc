"""Registered queries of extraction: nested declaration rows to symbols, side tables, edges, skips and errors.

Orders stand for declarations of eight kinds and their lineitems for what is nested in them; some have no place, no usr, no type or
a wrong range, some are of system headers or of files that are not indexed, and some records have bases that nobody knows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.plans import declarations
from factfold.plans.registered import big, query

_KINDS = ["function", "method", "record", "field", "variable", "enum", "enumerator", "alias"]
_ACCESS = ["public", "protected", "private"]
_WITH = f"""WITH i AS (SELECT l_orderkey AS seq, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1)::INT AS position, 'i' || l_partkey AS name,
  CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'c:@p' || l_partkey END AS item, {_ACCESS}[l_partkey % 3 + 1] AS item_access, l_returnflag = 'R' AS is_virtual, l_suppkey % 3 = 0 AS is_dependent, l_linestatus = 'O' AS is_pack,
  CASE WHEN l_returnflag = 'A' THEN l_quantity::INT::VARCHAR END AS default_text FROM lineitem),
d AS (SELECT o_orderkey AS seq, 'f' || o_custkey % 20 AS file, o_orderstatus <> 'P' AS is_indexed, o_orderpriority = '5-LOW' AS is_system, {_KINDS}[o_orderkey % 8 + 1] AS kind,
  CASE WHEN o_orderkey % 97 = 5 THEN '' ELSE 'c:@d' || o_orderkey END AS usr, 'n::d' || o_orderkey AS qualified_name, CASE WHEN o_orderkey % 89 <> 7 THEN (o_custkey % 1000)::INT END AS line, (o_orderkey % 80)::INT AS col,
  o_custkey AS "offset", floor(o_totalprice)::BIGINT % 100 - 2 AS size, o_orderkey % 3 <> 0 AS is_definition, 'c:@d' || o_orderkey // 8 AS owner, {_ACCESS}[o_custkey % 3 + 1] AS access,
  CASE o_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'c:@t' || o_custkey % 50 END AS type, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN 'true' ELSE 'f(x)' END AS expression,
  o_custkey % 2 = 0 AS is_scoped, o_custkey % 5 = 0 AS is_fixed FROM orders),
w AS (SELECT *, CASE WHEN line IS NULL THEN 'invalid source location' WHEN is_system THEN 'system header' WHEN NOT is_indexed THEN 'outside indexed files' WHEN usr = '' THEN 'invalid USR'
  WHEN kind IN ('function', 'method', 'record') AND is_definition AND size < 0 THEN 'invalid source range' WHEN kind IN ('field', 'variable', 'alias', 'enum') AND type IS NULL THEN 'invalid type' END AS problem FROM d),
g AS (SELECT * FROM w WHERE problem IS NULL), n AS (SELECT * FROM g JOIN i USING (seq)),
lost AS (SELECT seq, arg_min(name, position) AS name FROM n WHERE kind = 'record' AND is_definition AND NOT is_dependent AND item = '' GROUP BY seq)"""
_VALUE = "CASE expression WHEN 'true' THEN 'boolean' WHEN 'f(x)' THEN 'none' ELSE 'integer' END"


def _declarations(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    one_of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    words = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))
    usr = lambda x: F.when(x["l_suppkey"] % 10 == 0, "").otherwise(words("c:@p", x["l_partkey"]))
    name = lambda x: words("i", x["l_partkey"]).alias("name")
    base = F.transform("items", lambda x: F.struct(usr(x).alias("usr"), name(x), one_of(_ACCESS, x["l_partkey"] % 3).alias("access"), (x["l_returnflag"] == "R").alias("is_virtual"), (x["l_suppkey"] % 3 == 0).alias("is_dependent")))
    parameter = F.transform("items", lambda x: F.struct(name(x), usr(x).alias("type"), x["l_returnflag"].alias("type_text"), F.when(x["l_returnflag"] == "A", x["l_quantity"].cast("int").cast("string")).alias("default_text")))
    slot = F.transform("items", lambda x: F.struct(name(x), F.lit("type").alias("kind"), usr(x).alias("type"), (x["l_linestatus"] == "O").alias("is_pack")))
    kind = F.col("kind")
    rows = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("kind", one_of(_KINDS, key % 8))
    return rows.select(
        key.alias("seq"), words("f", cust % 20).alias("file"), (F.col("o_orderstatus") != "P").alias("is_indexed"), (F.col("o_orderpriority") == "5-LOW").alias("is_system"), "kind",
        F.when(key % 97 == 5, "").otherwise(words("c:@d", key)).alias("usr"), words("n::d", key).alias("qualified_name"), F.when(key % 89 != 7, (cust % 1000).cast("int")).alias("line"), (key % 80).cast("int").alias("col"),
        cust.alias("offset"), (F.floor("o_totalprice") % 100 - 2).alias("size"), (key % 3 != 0).alias("is_definition"), words("c:@d", F.floor(key / 8)).alias("owner"), one_of(_ACCESS, cust % 3).alias("access"),
        F.when(cust % 11 == 0, None).when(cust % 11 == 1, "").otherwise(words("c:@t", cust % 50)).alias("type"), F.when(cust % 4 == 0, None).when(cust % 4 == 1, key.cast("string")).when(cust % 4 == 2, "true").otherwise("f(x)").alias("expression"),
        (cust % 2 == 0).alias("is_scoped"), (cust % 5 == 0).alias("is_fixed"), F.when(kind == "record", base).alias("bases"), F.when(kind.isin("function", "method"), parameter).alias("parameters"), F.when(kind.isin("function", "record"), slot).alias("slots"),
    )


def _table(t, name):
    return declarations.Facts(_declarations(t)).table(name)


@query(f"{_WITH} SELECT usr, seq, file, qualified_name, kind, access, is_definition, line, col, \"offset\" FROM g")
def extracted_symbols(t):
    return _table(t, "symbol")


@query(f"{_WITH} SELECT usr, seq, file, \"offset\", size FROM g WHERE kind IN ('function', 'method', 'record') AND is_definition")
def extracted_definitions(t):
    return _table(t, "definition")


@query(f"{_WITH} SELECT usr, seq, position, name, item AS type, CASE WHEN default_text IS NOT NULL THEN 'A' WHEN is_virtual THEN 'R' ELSE 'N' END AS type_text, default_text IS NOT NULL AS has_default FROM n WHERE kind IN ('function', 'method')")
def extracted_parameters(t):
    return _table(t, "parameter")


@query(f"{_WITH} SELECT usr, seq, position, default_text AS expression, 'integer' AS evaluated_kind FROM n WHERE kind IN ('function', 'method') AND default_text IS NOT NULL")
def extracted_defaults(t):
    return _table(t, "parameter_default")


@query(f"{_WITH} SELECT usr, seq, position, name, 'type' AS kind, item AS type, is_pack FROM n WHERE kind IN ('function', 'record')")
def extracted_slots(t):
    return _table(t, "template_argument")


@query(f"{_WITH} SELECT usr, seq, type AS underlying_type, is_scoped, is_fixed AS has_fixed_underlying_type FROM g WHERE kind = 'enum'")
def extracted_enumerations(t):
    return _table(t, "enumeration")


@query(f"{_WITH} SELECT usr, seq, expression AS value, CASE WHEN expression IS NOT NULL THEN {_VALUE} ELSE 'none' END AS evaluated_kind FROM g WHERE kind = 'enumerator'")
def extracted_enumerators(t):
    return _table(t, "enumerator")


@query(f"{_WITH} SELECT usr, seq, expression, {_VALUE} AS evaluated_kind FROM g WHERE kind IN ('field', 'variable') AND expression IS NOT NULL")
def extracted_initializers(t):
    return _table(t, "variable_initializer")


@query(f"""{_WITH} SELECT usr AS source, seq, 'Inherits' AS kind, item AS destination, position, item_access AS access, is_virtual AS is_virtual_base FROM n WHERE kind = 'record' AND is_definition AND NOT is_dependent AND seq NOT IN (SELECT seq FROM lost)
UNION ALL SELECT usr, seq, CASE kind WHEN 'method' THEN 'MethodOf' ELSE 'FieldOf' END, owner, 0, access, NULL FROM g WHERE kind IN ('method', 'field')
UNION ALL SELECT usr, seq, 'Contains', owner, 0, NULL, NULL FROM g WHERE kind = 'enumerator'
UNION ALL SELECT usr, seq, CASE kind WHEN 'alias' THEN 'AliasOf' ELSE 'OfType' END, type, 0, NULL, NULL FROM g WHERE kind IN ('field', 'variable', 'alias') AND type <> ''
UNION ALL SELECT usr, seq, 'ParamType', item, position, NULL, NULL FROM n WHERE kind IN ('function', 'method') AND item <> ''""")
def extracted_relations(t):
    return _table(t, "relation")


@query(f"""{_WITH} SELECT usr, seq, CASE WHEN problem IN ('system header', 'outside indexed files') THEN 'skip' ELSE 'error' END AS severity, 'cannot extract symbol ''' || qualified_name || ''': ' || problem AS message FROM w WHERE problem IS NOT NULL
UNION ALL SELECT usr, seq, 'error', 'cannot resolve base ''' || name || ''' of ''' || qualified_name || ''': base declaration is unavailable' FROM g JOIN lost USING (seq)""")
def extracted_problems(t):
    return _table(t, "problem")


_PACK = """CASE l_linenumber % 5 WHEN 0 THEN '"p' || l_partkey || '"' WHEN 1 THEN '["s' || l_suppkey || '","p' || l_partkey || '"]' WHEN 2 THEN '["a",["b",["c",["p' || l_partkey || '"]],"d"]]' WHEN 3 THEN '[]' ELSE '[[],["x"],"p' || l_partkey || '"]' END"""


@query(f"""WITH RECURSIVE o AS (SELECT l_orderkey, ('[' || string_agg({_PACK}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']')::JSON AS v FROM lineitem GROUP BY 1),
w(l_orderkey, path, v) AS (SELECT l_orderkey, []::INT[], v FROM o UNION ALL SELECT l_orderkey, list_append(path, (i - 1)::INT), e[i] FROM (SELECT l_orderkey, path, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT l_orderkey, path, from_json(v, '["JSON"]') AS e FROM w WHERE json_type(v) = 'ARRAY')))
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY path) - 1 AS position, json_extract_string(v, '$') AS value, (CASE WHEN len(path) > 1 THEN path[2] ELSE -1 END)::BIGINT AS pack_index, len(path) - 1 AS depth FROM w WHERE json_type(v) <> 'ARRAY'""")
def template_values(t):
    """Template values of which some are packs of packs, four deep, and some packs are empty."""
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    one = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit('"p'), part, F.lit('"'))).when(F.col("l_linenumber") % 5 == 1, F.concat(F.lit('["s'), supp, F.lit('","p'), part, F.lit('"]')))
        .when(F.col("l_linenumber") % 5 == 2, F.concat(F.lit('["a",["b",["c",["p'), part, F.lit('"]],"d"]]'))).when(F.col("l_linenumber") % 5 == 3, "[]").otherwise(F.concat(F.lit('[[],["x"],"p'), part, F.lit('"]')))
    )
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", one.alias("one")))).alias("items"))
    rows = items.select("l_orderkey", F.parse_json(F.concat(F.lit("["), F.array_join("items.one", ","), F.lit("]"))).alias("v"))
    return declarations.template_values(rows, "l_orderkey", "v").select("l_orderkey", big("position").alias("position"), "value", big("pack_index").alias("pack_index"), big("depth").alias("depth"))
