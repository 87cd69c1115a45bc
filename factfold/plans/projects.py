"""Registered queries of command lines and the project registry, over varied lines, paths, clones and versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold import schema
from factfold.functions import argv, flags, paths
from factfold.operators import validate
from factfold.operators.lineage import shared_folder
from factfold.plans import registry, store
from factfold.plans.registered import big, query
from factfold.sources import readers
from factfold.streaming import upsert

# command lines ------------------------------------------------------------------------------------------------------

#: One argument of each kind and what becomes of it: x goes, n goes with the next one, k stays.
_ARGUMENTS = {
    "x": "-c -- -M -MM -MD -MMD -MG -MP -MV -Werror -pedantic-errors -shared -static -rdynamic -pie -no-pie -s -pipe -nostdlib -nodefaultlibs -nostartfiles -static-libgcc -shared-libgcc -static-libstdc++ -Werror=all -Wp,-MD,x -MF -MFx -MT -MTx -MQ -MQx -l -lm -L -L/lib -Wl,-z -Wa,-n -fuse-ld=lld -fmodules-cache-path=/m",
    "n": "-o -dependency-file --serialize-diagnostics -Xlinker -T",
    "k": "-Wall -O2 -g -S -E -save-temps -fcolor-diagnostics -MJ -W -Wp,-D -std=c++23 -I/x -isystem -DX=1 -Wno-error -sx -ox -cx -include a.h",
}
_CASES = [(flag, what) for what, names in _ARGUMENTS.items() for flag in names.split()]
_VALUES = ", ".join(f"({i}, '{flag}', '{what}')" for i, (flag, what) in enumerate(_CASES))


def _pick(values: list[str], by):
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


@query(f"""WITH f(i, flag, what) AS (VALUES {_VALUES})
SELECT p_partkey, CASE WHEN p_partkey // {len(_CASES)} % 2 = 0 THEN CASE what WHEN 'k' THEN ['-DA', flag, p_name, '-DB'] WHEN 'x' THEN ['-DA', p_name, '-DB'] ELSE ['-DA', '-DB'] END
  ELSE CASE what WHEN 'k' THEN ['-DA', p_name, flag] ELSE ['-DA', p_name] END END AS kept FROM part JOIN f ON i = p_partkey % {len(_CASES)}""")
def argv_sanitise(t):
    flag = _pick([f for f, _ in _CASES], F.col("p_partkey") % len(_CASES))
    line = F.when(F.expr(f"p_partkey div {len(_CASES)} % 2 = 0"), F.array(F.lit("-DA"), flag, F.col("p_name"), F.lit("-DB"))).otherwise(F.array(F.lit("-DA"), F.col("p_name"), flag))
    return t.part.select("p_partkey", argv.sanitise(line).alias("kept"))


_LEADS = ["ccache", "/usr/bin/sccache", "distcc", "icecc", "icerun", "env", "time", "nice", "A=1", "_a-b=x", "=x", "1A=2", "ccachex", "-A=1", "g++"]
_LED = 10  # the first so many stand in front of a compiler


@query(f"""WITH p AS (SELECT *, list_value({', '.join(f"'{x}'" for x in _LEADS)})[p_partkey % {len(_LEADS)} + 1] AS lead, p_partkey % {len(_LEADS)} < {_LED} AS led FROM part)
SELECT p_partkey, CASE WHEN led THEN ['cc', '-DN=' || p_size] ELSE [lead, 'cc', '-DN=' || p_size] END AS command, CASE WHEN led THEN ['-DN=' || p_size] ELSE [lead, 'cc', '-DN=' || p_size] END AS kept FROM p""")
def launcher_skip(t):
    line = F.array(_pick(_LEADS, F.col("p_partkey") % len(_LEADS)), F.lit("cc"), F.concat(F.lit("-DN="), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", argv.skip_launchers(line).alias("command"), argv.sanitise(line).alias("kept"))


@query("""SELECT p_partkey, 'x' || CASE p_size % 5 WHEN 0 THEN '/boost/' || p_brand WHEN 1 THEN '/a/b' WHEN 2 THEN '<>/boost' WHEN 3 THEN '</boost' ELSE '<open' END AS label,
  CASE p_size % 4 WHEN 0 THEN '/sys/' || p_brand || '/sys' WHEN 1 THEN '$UNSET/' || p_brand WHEN 2 THEN '${UNSET}' ELSE '/sys$' END AS env FROM part""")
def label_and_environment(t):
    by, brand = F.col("p_size") % 5, F.col("p_brand")
    label = F.when(by == 0, F.concat(F.lit("x<boost>/"), brand)).when(by == 1, "x<a-b>").when(by == 2, "x<><boost>").when(by == 3, "x<<boost>").otherwise("x<open")
    env = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("$ROOT/"), brand, F.lit("${ROOT}"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("$UNSET/"), brand)).when(F.col("p_size") % 4 == 2, "${UNSET}").otherwise("${ROOT}$")
    return t.part.select("p_partkey", argv.expand_labels(label, {"boost": "/boost", "<boost": "</boost"}).alias("label"), argv.expand_environment(env, {"ROOT": "/sys"}).alias("env"))


@query("""WITH f(i, flag, joined) AS (VALUES (0, '-I', '-I'), (1, '-isystem', '-isystem'), (2, '-iquote', '-iquote'), (3, '-idirafter', '-idirafter'), (4, '-F', '-F'), (5, '-iframework', '-iframework'),
  (6, '-include', '-include'), (7, '-imacros', '-imacros'), (8, '-isysroot', '-isysroot'), (9, '--sysroot', '--sysroot='), (10, '-resource-dir', '-resource-dir'), (11, '-include-pch', '-include-pch'))
SELECT p_partkey, CASE WHEN i < 6 THEN ['/w/inc' || p_size, '/w/more'] ELSE []::VARCHAR[] END AS roots, ['cc', flag, '<lib>/inc' || p_size, joined || '<lib>/more', 'a.cpp'] AS stored,
  ['cc', flag, '/h/inc' || p_size, CASE WHEN flag IN ('--sysroot', '-include-pch') THEN joined || '~/more' ELSE joined || '/h/more' END, 'a.cpp'] AS resolved FROM part JOIN f ON i = p_partkey % 12""")
def command_includes(t):
    # joined, -include-pch is read as -include, and --sysroot with its = begins no path
    flags_ = ["-I", "-isystem", "-iquote", "-idirafter", "-F", "-iframework", "-include", "-imacros", "-isysroot", "--sysroot", "-resource-dir", "-include-pch"]
    flag = _pick(flags_, F.col("p_partkey") % 12)
    join = F.concat(flag, F.when(flag.startswith("--"), "=").otherwise(""))
    size = F.col("p_size").cast("string")
    line = F.array(F.lit("cc"), flag, F.concat(F.lit("inc"), size), F.concat(join, F.lit("more")), F.lit("a.cpp"))
    home = F.array(F.lit("cc"), flag, F.concat(F.lit("~/inc"), size), F.concat(join, F.lit("~/more")), F.lit("a.cpp"))
    stored = argv.portable_includes(line, lambda v: paths.portable(paths.normalise(v, F.lit("/w")), F.lit("/w"), F.lit("lib")))
    resolved = argv.resolve_includes(home, lambda v: argv.resolve_path(v, {}, {}, "/h", "/w"))
    # a fifth of a millisecond a row from a file of few bytes a row, which alone would make a few long tasks
    part = t.part.select("p_partkey", "p_size")
    part = part.repartition(1 + part.count() // 20_000, "p_partkey")
    return part.select("p_partkey", argv.include_roots(line, F.lit("/w")).alias("roots"), stored.alias("stored"), resolved.alias("resolved"))


_PROGRAMS = {"clang": 1, "clang++": 1, "clang++-19": 1, "clang-19": 1, "clang-tool": 0, "gcc": 1, "gcc-14": 1, "cc": 1, "c++": 1, "g++": 1, "g++-14": 0, "icc": 0, "/usr/bin/clang": 1, "/gone/cc": 0, "clangd": 0}


@query(f"""WITH f(i, program, ok) AS (VALUES {', '.join(f"({i}, '{p}', {ok})" for i, (p, ok) in enumerate(_PROGRAMS.items()))})
SELECT p_partkey, CASE WHEN ok = 1 THEN program WHEN p_size % 2 = 0 THEN 'clang' ELSE 'clang++' END AS driver FROM part JOIN f ON i = p_partkey % {len(_PROGRAMS)}""")
def compiler_driver(t):
    program = _pick(list(_PROGRAMS), F.col("p_partkey") % len(_PROGRAMS))
    source = F.when(F.col("p_size") % 2 == 0, "/s/a.c").otherwise("/s/a.cc")
    line = F.array(F.lit("ccache"), program, F.lit("-c"))
    return t.part.select("p_partkey", argv.driver(line, source, program.startswith("/usr/")).alias("driver"))


@query("""SELECT DISTINCT unnest(['/w/' || p_brand || '/src', '/inc/' || p_type, '/w/' || p_brand || '/more']) AS directory FROM part""")
def search_directories(t):
    directory = F.concat(F.lit("/w/"), F.col("p_brand"))
    line = F.array(F.lit("cc"), F.lit("-isystem"), F.concat(F.lit("/inc/x/../"), F.col("p_type")), F.lit("-Imore"), F.lit("-DI"))
    return readers.search_directories(t.part.select(directory.alias("directory"), F.concat(F.lit("src/./"), F.col("p_name"), F.lit(".cc")).alias("file"), line.alias("arguments")))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' OR p_brand = 'Brand#3'")
def commands_of_sources(t):
    """The commands of the sources asked for, whose paths are spelled in different ways."""
    spelled = t.part.select("p_partkey", F.concat(F.lit("/s/./x/../"), "p_brand").alias("file"))
    return readers.commands_for(spelled.withColumn("directory", F.lit("/")), ["/s/Brand#2", "/s//Brand#3"]).select("p_partkey")


# registry -----------------------------------------------------------------------------------------------------------


def _commands(t) -> DataFrame:
    """Two commands for every part of size above 40, one for others; below /w/<brand number> or outside of it."""
    at = F.concat(F.lit("/w/"), F.regexp_extract("p_brand", "#(.*)$", 1))
    file = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".cc"))
    line = lambda first, more: F.array(F.lit("ccache"), first, F.lit("-c"), file, F.lit("-Iinc"), more, F.lit("-o"), F.lit("x.o"), F.lit("-L/lib"))
    one = t.part.select("p_partkey", at.alias("directory"), file.alias("file"), line(F.lit("g++"), F.lit("-DB")).alias("arguments"))
    two = t.part.where("p_size > 40").select("p_partkey", at.alias("directory"), file.alias("file"), line(F.lit("g++"), F.lit("-DA")).alias("arguments"))
    return one.unionByName(two)


def _roots(t) -> DataFrame:
    """Components of the brands with an even number, and one below /w/2."""
    number = F.regexp_extract("p_brand", "#(.*)$", 1)
    brands = t.part.select(number.alias("k")).distinct().where(F.col("k").cast("int") % 2 == 0).select(F.concat(F.lit("c"), "k").alias("name"), F.concat(F.lit("/w/"), "k").alias("root"))
    return brands.unionByName(t.spark.createDataFrame([("deep", "/w/2/src")], "name string, root string"))


_NUMBER = "regexp_extract(p_brand, '#(.*)$', 1)"
_OWNED = f"""WITH c AS (SELECT *, {_NUMBER} AS k, '/w/' || {_NUMBER} || '/src/f' || p_partkey || '.cc' AS source FROM part)"""


@query(f"""{_OWNED} SELECT source, CASE WHEN k = '2' THEN 'deep' ELSE 'c' || k END AS component, CASE WHEN k = '2' THEN '' ELSE 'src' END AS directory, 'f' || p_partkey || '.cc' AS name, 'g++' AS driver,
  CASE WHEN k = '2' THEN '/w/2' ELSE '<c' || k || '>' END AS working_directory, '["-I' || CASE WHEN k = '2' THEN '/w/2' ELSE '<c' || k || '>' END || '/inc","' || CASE WHEN p_size > 40 THEN '-DA' ELSE '-DB' END || '"]' AS options,
  CASE WHEN p_size > 40 THEN 1 ELSE 0 END::BIGINT AS duplicates FROM c WHERE k::INT % 2 = 0""")
def import_prepare(t):
    return registry.prepare(_commands(t), _roots(t))


@query(f"{_OWNED} SELECT source, 'source is outside every configured component: ' || source AS error FROM c WHERE k::INT % 2 = 1")
def import_refused(t):
    return registry.outside(_commands(t), _roots(t))


@query("SELECT '/w' AS root FROM part HAVING count(*) > 0")
def import_common_root(t):
    return registry.common_root(_commands(t))


@query(f"""{_OWNED}, s AS (SELECT 10 + row_number() OVER (ORDER BY source) AS id, source AS path FROM c WHERE p_partkey % 3 = 0 AND k::INT % 2 = 0)
SELECT id, path FROM s UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM s) + row_number() OVER (ORDER BY source), source FROM c WHERE p_partkey % 3 <> 0 AND k::INT % 2 = 0""")
def register_files(t):
    every = registry.prepare(_commands(t), _roots(t)).select(F.col("source").alias("path"))
    number = F.regexp_extract("path", "f([0-9]+)", 1).cast("int")
    empty = t.spark.createDataFrame([(10, "/none", "/")], "id long, path string, owner string")
    stored = registry.register_files(empty, every.where(number % 3 == 0), _roots(t)).where("id > 10")
    spelled = _commands(t).select(F.concat("directory", F.lit("/./x/../"), "file").alias("path")).unionByName(t.spark.createDataFrame([("/else/x.h",)], "path string"))
    return registry.register_files(stored, spelled, _roots(t)).select("id", "path")


@query(f"""{_OWNED} SELECT p_partkey AS id, source AS path, CASE WHEN k::INT % 2 = 0 THEN 'g++' END AS driver, k::INT % 2 = 0 AS has_options FROM c""")
def import_commands(t):
    source = F.concat(F.lit("/w/"), F.regexp_extract("p_brand", "#(.*)$", 1), F.lit("/src/f"), F.col("p_partkey").cast("string"), F.lit(".cc"))
    files = t.part.select(F.col("p_partkey").alias("id"), source.alias("path"), F.lit("old").alias("driver"), F.lit("[]").alias("compile_options"), F.lit("/").alias("working_directory"))
    out = registry.import_commands(files, registry.prepare(_commands(t), _roots(t)))
    return out.select("id", "path", "driver", F.col("compile_options").isNotNull().alias("has_options"))


@query("""WITH b AS (SELECT DISTINCT p_brand AS path FROM part), c AS (SELECT row_number() OVER (ORDER BY path) AS id, path FROM b WHERE path < 'Brand#2'),
n AS (SELECT id, path FROM c UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM c) + row_number() OVER (ORDER BY path), path FROM b WHERE path >= 'Brand#2'), f AS (SELECT n.id AS component_id, p_partkey, p_size FROM part JOIN n ON p_brand = path),
s AS (SELECT row_number() OVER (ORDER BY component_id, p_partkey::VARCHAR) AS id, component_id, p_partkey::VARCHAR AS name FROM f WHERE p_size % 2 = 0 AND component_id <= (SELECT coalesce(max(id), 0) FROM c))
SELECT id, component_id, name, (SELECT max(p_size) FROM f WHERE p_partkey::VARCHAR = name AND p_size > 20) AS size FROM s
UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM s) + row_number() OVER (ORDER BY component_id, p_partkey::VARCHAR), component_id, p_partkey::VARCHAR, p_size FROM f
WHERE p_size > 20 AND NOT EXISTS (SELECT 1 FROM s WHERE s.component_id = f.component_id AND name = p_partkey::VARCHAR)""")
def replace_configuration(t):
    """Even sizes of the first brands are stored; then a configuration of all sizes above 20 is taken over. A bad one changes nothing."""
    brands = t.part.select(F.col("p_brand").alias("path")).distinct().select(F.col("path").alias("name"), "path")
    empty = {"component": t.spark.createDataFrame([], "id long, name string, path string"), "file": t.spark.createDataFrame([], "id long, component_id long, directory string, name string, driver string, compile_options string, size int")}
    file = t.part.select(F.col("p_brand").alias("component_path"), F.lit("").alias("directory"), F.col("p_partkey").cast("string").alias("name"), F.lit("cc").alias("driver"), F.lit("[]").alias("compile_options"), F.col("p_size").alias("size"))
    early = file.where("component_path < 'Brand#2' and size % 2 = 0")
    first = registry.replace_configuration(empty, brands.where("path < 'Brand#2'"), early)
    first["file"] = first["file"].withColumn("size", F.lit(None).cast("int"))
    try:
        registry.replace_configuration(first, brands.unionByName(brands), file)
    except registry.RegistryError:
        after = registry.replace_configuration(first, brands, file.where("size > 20"))
    return after["file"].select("id", "component_id", "name", "size")


@query("""SELECT s_name AS name, CASE WHEN s_suppkey = 3 THEN 2 * s_suppkey + 1 WHEN s_suppkey = 4 THEN (SELECT max(s_suppkey) * 2 + 2 FROM supplier) ELSE 2 * s_suppkey END AS active_clone_id FROM supplier""")
def clone_switch(t):
    """Each repository has two clones; one is switched by its label, and another gets a third clone and takes it."""
    repositories = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 2).alias("active_clone_id"))
    clone = lambda k: t.supplier.select((F.col("s_suppkey") * 2 + k).alias("id"), F.col("s_suppkey").alias("repository_id"), F.concat(F.lit(f"/clone{k}/"), "s_name").alias("path"), F.lit(f"label{k}").alias("label"))
    clones = clone(0).unionByName(clone(1))
    switched = registry.switch_clone(repositories, clones, "Supplier#000000003", "label1")
    after, _ = registry.add_clone(switched, clones, "Supplier#000000004", "/third", "new", activate=True)
    return after.select("name", "active_clone_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '/clone/' || p_brand || '/v' || p_size % 7 ELSE '/abs/' || p_brand || '/v' || p_size % 7 END || CASE WHEN p_size % 2 = 0 THEN '/src' ELSE '' END || '/' || p_name AS path,
  p_brand AS component, ['-D' || p_type] AS options FROM part WHERE p_partkey % 4 <> 0""")
def stored_files(t):
    """Files of components with versions, half of them below the active clone of a repository."""
    key = F.col("p_partkey")
    files = t.part.select(key.alias("id"), key.alias("directory_id"), F.col("p_name").alias("name"), F.when(key % 4 != 0, F.to_json(F.array(F.concat(F.lit("-D"), "p_type")))).alias("compile_options"), F.lit("cc").alias("driver"), F.lit("/").alias("working_directory"))
    directories = t.part.select(key.alias("id"), key.alias("component_id"), F.when(F.col("p_size") % 2 == 0, "src").otherwise("").alias("path"))
    anchored = F.col("p_size") % 3 == 0
    components = t.part.select(key.alias("id"), F.col("p_brand").alias("name"), F.when(anchored, F.col("p_brand")).otherwise(F.concat(F.lit("/abs/"), "p_brand")).alias("path"), F.concat(F.lit("v"), (F.col("p_size") % 7).cast("string")).alias("version"), F.when(anchored, 1).alias("repository_id"))
    repositories, clones = t.spark.createDataFrame([(1, 5)], "id long, active_clone_id long"), t.spark.createDataFrame([(5, "/clone")], "id long, path string")
    return registry.stored_files(files, directories, components, repositories, clones).select("id", "path", "component", "options")


@query(f"""{_OWNED} SELECT p_partkey + 1 AS id, CASE WHEN k = '2' THEN '' ELSE 'src' END AS directory, 'f' || p_partkey || '.cc' AS name, CASE WHEN k = '2' THEN 'deep' ELSE 'c' || k END AS component FROM c WHERE k::INT % 2 = 0""")
def migrate_registry(t):
    """A registry of flat directories to components, directories and names; ids of files stay."""
    at = F.concat(F.lit("/w/"), F.regexp_extract("p_brand", "#(.*)$", 1), F.lit("/src"))
    flat = t.part.where(F.regexp_extract("p_brand", "#(.*)$", 1).cast("int") % 2 == 0).select((F.col("p_partkey") + 1).alias("id"), F.crc32(F.encode(at, "utf-8")).alias("directory_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".cc")).alias("name"), at.alias("at"))
    directories = flat.select(F.col("directory_id").alias("id"), F.col("at").alias("path")).distinct()
    roots = _roots(t).select(F.crc32(F.encode("root", "utf-8")).alias("id"), "name", "root")
    split, files = registry.split_flat_paths(registry.join_flat_directories(flat, directories), roots)
    named = split.join(roots.select(F.col("id").alias("component_id"), F.col("name").alias("component")), "component_id")
    return files.join(named, "directory_id").select("id", "directory", "name", "component")


@query("""SELECT o_orderkey AS id, ['public', 'protected', 'private', 'none'][(o_orderkey & 3) + 1] AS access, ['none', 'lvalue', 'rvalue', 'rvalue'][((o_orderkey >> 9) & 3) + 1] AS ref_qualifier,
  ((o_orderkey >> 2) & 1)::INT AS is_definition, ((o_orderkey >> 5) & 1)::INT AS is_virtual, ((o_orderkey >> 8) & 1)::INT AS is_pure, ((o_orderkey >> 11) & 1)::INT AS is_override FROM orders""")
def migrate_symbol_flags(t):
    out = store.migrate_symbol_flags(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("flags")))
    return out.select("id", "access", "ref_qualifier", "is_definition", "is_virtual", "is_pure", "is_override")


@query("""SELECT unnest(['component', 'file', 'label', 'file', 'file']) AS table_name, unnest(['', '', '', 'md5', 'packed']) AS column_name, unnest(['missing', 'unexpected', 'unexpected', 'missing', 'unexpected']) AS problem
EXCEPT SELECT 'file', '', 'unexpected'""")
def table_set(t):
    """Tables and columns that a store has and should not, and the other way round."""
    wanted = {"component": ["id"], "file": ["id", "md5"]}
    return validate.schema_differences(t.spark, {"file": t.part.select(F.col("p_partkey").alias("id"), F.lit(1).alias("packed")), "label": t.part}, wanted)


@query("SELECT p_partkey AS id, p_brand AS directory, CASE WHEN p_size > 10 THEN 1 ELSE 0 END AS is_system FROM part WHERE p_size > 5")
def component_files(t):
    """Files found in trees and named by commands, each once, without the main file's own."""
    tree = t.part.where("p_size > 5").select(F.col("p_partkey").cast("string").alias("path"))
    commands = t.part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("file"))
    found = readers.discover(commands, tree).select(big("path").alias("id"))
    listed = commands.select(big("file").alias("id"), F.lit(1).alias("is_system"))
    named = found.join(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("directory")), "id").join(listed, "id", "left")
    return named.select("id", "directory", F.coalesce("is_system", F.lit(0)).alias("is_system"))


@query("SELECT o_orderkey, (o_orderkey % 5 + 1)::INT AS code, ['Function', 'Record', 'Enumeration', 'Variable', 'Symbol'][o_orderkey % 5 + 1] AS node, CASE o_orderkey % 5 WHEN 0 THEN 'specialised' WHEN 1 THEN 'specialised' ELSE 'generic' END AS route FROM orders")
def node_dispatch(t):
    """Which side table a symbol goes to, by its coded node."""
    code = (F.col("o_orderkey") % 5 + 1).cast("int")
    rows = t.orders.select("o_orderkey", code.alias("code")).join(F.broadcast(schema.dimension(t.spark, schema.NODES).withColumnRenamed("name", "node")), "code")
    return rows.select("o_orderkey", "code", "node", flags.classify(F.col("node"), {"specialised": ["Function", "Record"]}, "generic").alias("route"))


# the store ----------------------------------------------------------------------------------------------------------


def _store(t) -> store.Store:
    return store.Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, 'second' AS version, (SELECT count(*) FROM region)::BIGINT AS others FROM nation WHERE n_nationkey % 2 = 0")
def store_versions(t):
    """Two tables are written together, then one of them anew; a write that fails switches nothing."""
    at = _store(t)
    rows = t.nation.select(big("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    at.replace(t.spark, {"nation": rows, "region": t.region}, {"version": "first"})
    at.replace(t.spark, {"nation": rows.where("id % 2 = 0")}, {"version": "second"})
    try:
        at.replace(t.spark, {"nation": rows.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))}, {"version": "third"})
    except Exception as e:
        if "broken" not in str(e):
            raise
    return at.read("nation").withColumn("version", F.lit(at.property("version"))).withColumn("others", F.lit(at.read("region").count()))


@query("""SELECT o_custkey AS usr, max((o_totalprice > 200000)::INT) AS defined, arg_max(o_orderstatus, o_orderkey) AS access, arg_min(o_totalprice, o_orderkey) AS first_price,
  coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW'), '5-LOW') AS priority, count(*)::BIGINT AS sightings FROM orders GROUP BY 1""")
def upsert_stream(t):
    """Orders as a stream of sightings in four batches of which the newest comes first; a fifth run finds nothing new."""
    root, keys = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}", ["usr"]
    rules = {"defined": "or", "access": "last", "first_price": "first", "priority": "last_but:5-LOW", "sightings": "sum"}
    source = t.orders.select(F.col("o_custkey").alias("usr"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") > 200000).cast("int").alias("defined"), F.col("o_orderstatus").alias("access"), F.col("o_totalprice").alias("first_price"), F.col("o_orderpriority").alias("priority"), F.lit(1).cast("long").alias("sightings"))
    most = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
    for part in [3, 2, 1, 0, None]:
        if part is not None:
            within = (F.col("seq") * 4 >= part * (most + 1)) & (F.col("seq") * 4 < (part + 1) * (most + 1))
            source.where(within).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(source.schema).parquet(f"{root}/in")
        upsert.upsert_stream(stream, f"{root}/states", keys, rules, ["seq"], f"{root}/checkpoint").awaitTermination()
    return upsert.upserted(t.spark, f"{root}/states", keys, rules)
