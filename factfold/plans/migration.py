"""Fact tables of older stores in the present columns, and upserts of projects and files by their own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold import schema
from factfold.functions import flags
from factfold.operators.lineage import cut
from factfold.plans.registered import big, query
from factfold.plans.registry import RegistryError, upsert

#: The bit of each flag that older stores packed into ``flags``, by table, beside those of the symbols.
_TYPE_BITS = {"is_pointer": 0, "is_lvalue_reference": 1, "is_rvalue_reference": 2, "is_forwarding_reference": 3, "is_const": 4, "is_pack": 5}
PACKED_BITS = {
    "symbol": flags.SYMBOL_BITS,
    "parameter": _TYPE_BITS,
    "template_parameter": _TYPE_BITS,
    "template_argument": {"is_parameter_pack": 0, "is_non_type": 1, "is_template_template": 2},
    "relation": {"is_virtual_base": 2, "is_implicit": 3, "is_lexical": 4},
}
#: The packed fields of several bits, and what columns of later versions hold where a store lacks them.
PACKED_FIELDS = {"symbol": flags.SYMBOL_FIELDS, "relation": {"access": (0, 2, schema.ACCESS)}}
DEFAULTS = {"access": "none", "ref_qualifier": "none", "constant_evaluation": "none", "has_default": 0}


def migrate_table(table: str, rows: DataFrame) -> DataFrame:
    """rows with exactly the present columns of a fact table.

    Packed ``flags`` are unfolded (null flags hold nothing), flags that no column and no bit tells are 0, names of several values "none",
    and columns that the table no longer has are left out. Rows of the present version come out as they are. A missing column without
    a default raises.
    """
    bits, fields = PACKED_BITS.get(table, {}), PACKED_FIELDS.get(table, {})
    packed, known = "flags" in rows.columns, {c.lower() for c in rows.columns}
    word = F.coalesce(F.col("flags").cast("long"), F.lit(0)) if packed else None
    out = []
    for wanted in schema.empty(rows.sparkSession, table).schema:
        name = wanted.name
        if name.lower() in known:
            value = F.col(name)
        elif packed and name in bits:
            value = flags.bit(word, bits[name])
        elif packed and name in fields:
            value = F.when(F.col("flags").isNull(), F.lit(DEFAULTS[name])).otherwise(flags.field(word, *fields[name]))
            if name == "ref_qualifier":  # the unused fourth value says nothing
                value = F.when(F.shiftrightunsigned(word, fields[name][0]).bitwiseAND(F.lit(3)) == 3, "none").otherwise(value)
        elif name in bits or name in DEFAULTS:
            value = F.lit(DEFAULTS.get(name, 0))
        else:
            raise RegistryError(f"{table} has no {name}")
        out.append(value.cast(wanted.dataType).alias(name))
    return rows.select(*out)


def migrate(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All fact tables in their present columns; those that a store doesn't have yet are empty. Every table is one map over its rows, and
    migrating twice changes nothing."""
    return {name: migrate_table(name, tables[name]) if name in tables else schema.empty(spark, name) for name in schema.FACTS}


def upsert_files(stored: dict[str, DataFrame], found: DataFrame) -> dict[str, DataFrame]:
    """The directory and file tables with the files found (component_id, directory, name) in them, each once; what is there keeps its
    id. Rows without a component, directory or name are nobody's and are left out."""
    found = cut(found.select("component_id", "directory", "name").dropna().distinct())
    wanted = found.select("component_id", F.col("directory").alias("path")).distinct()
    directories = cut(upsert(stored["directory"], wanted, ["component_id", "path"], "id"))
    at = directories.select(F.col("id").alias("directory_id"), "component_id", F.col("path").alias("directory"))
    placed = found.join(at, ["component_id", "directory"]).select("directory_id", "name")
    return stored | {"directory": directories, "file": upsert(stored["file"], placed, ["directory_id", "name"], "id")}


def upsert_projects(stored: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """The repository and clone tables with projects (name, remote_url, path, label) taken over.

    Repositories are one by name and get the new address, clones one by path and get the new label, but stay their repository's; the
    clone becomes its repository's active one. Of several rows of a name the one of the greatest path tells the address and the
    active clone, of several of a path the one of the greatest name the label. Rows without name or path raise.
    """
    if not projects.where("name is null or name = '' or path is null or path = ''").isEmpty():
        raise RegistryError("projects without a name or a path")
    latest = cut(projects.groupBy("name").agg(F.max_by("remote_url", "path").alias("remote_url"), F.max("path").alias("active")))
    repositories = cut(upsert(stored["repository"], latest.select("name", "remote_url"), ["name"], "id"))
    by_path = projects.groupBy("path").agg(F.max_by("label", "name").alias("label"), F.max("name").alias("name"))
    own = by_path.join(repositories.select("name", F.col("id").alias("__new")), "name").join(stored["clone"].select("path", F.col("repository_id").alias("__old")), "path", "left")
    clones = cut(upsert(stored["clone"], own.select("path", "label", F.coalesce("__old", "__new").alias("repository_id")), ["path"], "id"))
    active = latest.select("name", F.col("active").alias("path")).join(clones.select("path", F.col("id").alias("__active")), "path").select("name", "__active")
    switched = repositories.join(active, "name", "left").withColumn("active_clone_id", F.coalesce("__active", "active_clone_id")).drop("__active")
    return stored | {"repository": switched.select(repositories.columns), "clone": clones}


def _bits(word: str, places: dict[str, int]) -> str:
    return ", ".join(f"(({word} >> {place}) & 1)::INT AS {name}" for name, place in places.items())


_ACCESS_SQL = "['public', 'protected', 'private', 'none'][({} & 3) + 1] AS access"


@query(f"""SELECT o_orderkey AS id, {_ACCESS_SQL.format("w")}, ['none', 'lvalue', 'rvalue', 'none'][((w >> 9) & 3) + 1] AS ref_qualifier,
  ['none', 'constexpr', 'consteval', 'constinit'][((w >> 22) & 3) + 1] AS constant_evaluation, {_bits("w", flags.SYMBOL_BITS)}, o_orderpriority AS usr FROM (SELECT *, o_orderkey * 7919 AS w FROM orders)""")
def migrated_symbols(t):
    """Symbols of the first version, with all their flags in one word."""
    none = {c: F.lit(0).alias(c) for c in ("node", "kind", "sub_kind", "lang", "properties", "line", "col", "offset")}
    old = t.orders.select(big("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("identity"), *none.values(), F.col("o_orderpriority").alias("usr"), F.col("o_orderpriority").alias("qualified_name"), (big("o_orderkey") * 7919).alias("flags"))
    out = migrate(t.spark, {"symbol": old})["symbol"]
    return out.select("id", *PACKED_FIELDS["symbol"], *PACKED_BITS["symbol"], "usr")


@query(f"SELECT l_orderkey AS symbol_id, l_linenumber::INT AS position, l_returnflag AS name, {_bits('l_partkey', _TYPE_BITS)}, 0 AS has_default FROM lineitem")
def migrated_parameters(t):
    place = {c: F.lit(0).alias(c) for c in ("line", "col", "offset", "region_offset", "region_size")}
    old = t.lineitem.select(big("l_orderkey").alias("symbol_id"), F.col("l_linenumber").cast("int").alias("position"), F.col("l_returnflag").alias("name"), F.lit(0).cast("long").alias("type"), *place.values(), F.col("l_partkey").alias("flags"))
    return migrate(t.spark, {"parameter": old})["parameter"].select("symbol_id", "position", "name", *_TYPE_BITS, "has_default")


@query(f"SELECT l_orderkey AS source_id, l_suppkey AS destination_id, {_ACCESS_SQL.format('l_partkey')}, {_bits('l_partkey', PACKED_BITS['relation'])} FROM lineitem")
def migrated_relations(t):
    old = t.lineitem.select(big("l_orderkey").alias("source_id"), big("l_suppkey").alias("destination_id"), F.lit(1).alias("kind"), F.lit(0).alias("position"), F.lit(1).alias("count"), big("l_partkey").alias("flags"))
    return migrate(t.spark, {"relation": old})["relation"].select("source_id", "destination_id", "access", *PACKED_BITS["relation"])


@query("""WITH d AS (SELECT s_suppkey AS id, s_suppkey AS component_id, 'd1' AS path FROM supplier), f AS (SELECT s_suppkey * 10 AS id, s_suppkey AS directory_id, 'f1' AS name FROM supplier),
l AS (SELECT DISTINCT l_suppkey AS component_id, 'd' || l_linenumber AS directory, 'f' || l_partkey AS name FROM lineitem),
d2 AS (SELECT * FROM d UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM d) + row_number() OVER (ORDER BY component_id, directory), component_id, directory FROM (SELECT DISTINCT component_id, directory FROM l) x
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.component_id = x.component_id AND d.path = x.directory)),
p AS (SELECT d2.id AS directory_id, name FROM l JOIN d2 ON l.component_id = d2.component_id AND directory = path),
f2 AS (SELECT * FROM f UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM f) + row_number() OVER (ORDER BY directory_id, name), directory_id, name FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.directory_id = p.directory_id AND f.name = p.name))
SELECT f2.id, d2.component_id, d2.path AS directory, f2.name FROM f2 JOIN d2 ON f2.directory_id = d2.id""")
def upserted_files(t):
    """Each component has one directory with one file; all others are added."""
    directory = t.supplier.select(big("s_suppkey").alias("id"), big("s_suppkey").alias("component_id"), F.lit("d1").alias("path"))
    file = t.supplier.select((big("s_suppkey") * 10).alias("id"), big("s_suppkey").alias("directory_id"), F.lit("f1").alias("name"))
    text = lambda c: F.col(c).cast("string")
    found = t.lineitem.select(big("l_suppkey").alias("component_id"), F.concat(F.lit("d"), text("l_linenumber")).alias("directory"), F.concat(F.lit("f"), text("l_partkey")).alias("name"))
    after = upsert_files({"directory": directory, "file": file}, found)
    at = after["directory"].select(F.col("id").alias("directory_id"), "component_id", F.col("path").alias("directory"))
    return after["file"].join(at, "directory_id").select("id", "component_id", "directory", "name")


@query("""WITH n AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey FROM supplier), r AS (SELECT k AS id, name FROM n WHERE k % 2 = 0), p AS (SELECT * FROM n WHERE k % 3 <> 0),
r2 AS (SELECT r.id, r.name, coalesce('url' || p.s_nationkey, 'old') AS remote_url FROM r LEFT JOIN p USING (name)
  UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM r) + row_number() OVER (ORDER BY name), name, 'url' || s_nationkey FROM p WHERE k % 2 <> 0),
c AS (SELECT k AS id, '/c/' || name AS path FROM n WHERE k % 4 = 0),
c2 AS (SELECT * FROM c UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM c) + row_number() OVER (ORDER BY name), '/c/' || name FROM p WHERE k % 4 <> 0)
SELECT r2.id, r2.name, remote_url, c2.id AS active_clone_id FROM r2 LEFT JOIN p ON p.name = r2.name LEFT JOIN c2 ON path = '/c/' || p.name""")
def upserted_projects(t):
    """Half of the repositories and a quarter of the clones are stored; two thirds of all projects are taken over."""
    at = F.concat(F.lit("/c/"), "s_name")
    repository = t.supplier.where("s_suppkey % 2 = 0").select(big("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("old").alias("remote_url"), F.lit(None).cast("long").alias("active_clone_id"))
    clone = t.supplier.where("s_suppkey % 4 = 0").select(big("s_suppkey").alias("id"), big("s_suppkey").alias("repository_id"), at.alias("path"), F.lit("old").alias("label"))
    projects = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.concat(F.lit("url"), F.col("s_nationkey").cast("string")).alias("remote_url"), at.alias("path"), F.lit("new").alias("label"))
    after = upsert_projects({"repository": repository, "clone": clone}, projects)
    return after["repository"].select("id", "name", "remote_url", "active_clone_id")
