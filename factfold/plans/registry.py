"""The project registry: import of compile commands, file registration, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.functions import argv, paths
from factfold.operators.allocate import numbered_rows
from factfold.operators.lineage import cut
from factfold.operators.resolve import deterministic_winner, longest_prefix_owner


class RegistryError(ValueError):
    """A configuration that can't be taken over; nothing is changed."""


def prepare(commands: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per source in a component: (source, component, directory, name, driver, working_directory, options, duplicates).

    commands (directory, file, arguments); roots (name, root). The source's own mentions leave its arguments, paths below the
    component become portable, and of several commands of a source the smallest by key wins. Sources outside all components are
    those of ``outside``.
    """
    source, argv_ = paths.normalise(F.col("file"), F.col("directory")), F.col("arguments")
    rows = commands.where(F.size("arguments") > 0).select(source.alias("source"), F.col("directory").alias("cwd"), "file", "arguments")
    owned = longest_prefix_owner(rows, "source", roots, "root").where("owner is not null")
    named = owned.join(roots.select(F.col("root").alias("owner"), F.col("name").alias("component")), "owner")
    within = lambda value: paths.portable(paths.normalise(value, F.col("cwd")), F.col("owner"), F.col("component"))
    mentions = lambda x: (x == F.col("file")) | (x == F.col("source")) | (~x.startswith("-") & (paths.normalise(x, F.col("cwd")) == F.col("source")))
    options = argv.sanitise(F.filter(F.slice(argv_, argv.command_start(argv_) + 2, F.size(argv_)), lambda x: ~mentions(x)))
    relative = F.substr(F.col("source"), F.length("owner") + 2, F.length("source"))
    ready = named.select(
        "source", "component", paths.dirname(relative).alias("directory"), paths.basename(relative).alias("name"), argv.driver(argv_, F.col("source")).alias("driver"),
        within(F.col("cwd")).alias("working_directory"), argv.portable_includes(options, within).alias("kept"), "cwd", F.get(argv_, argv.command_start(argv_)).alias("program"),
    )
    keyed = ready.withColumn("key", argv.composite_key(F.col("source"), F.col("cwd"), F.col("program"), F.col("kept")))
    winners = deterministic_winner(keyed.withColumn("options", argv.encode_options(F.col("kept"))).drop("cwd", "program", "kept"), ["source"], ["key"])
    return winners.drop("key")


def outside(commands: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, error) of the commands whose source no component owns; an import with one of them is refused."""
    source = paths.normalise(F.col("file"), F.col("directory"))
    lost = longest_prefix_owner(commands.select(source.alias("source")).distinct(), "source", roots, "root").where("owner is null")
    return lost.select("source", F.concat(F.lit("source is outside every configured component: "), "source").alias("error"))


def common_root(commands: DataFrame) -> DataFrame:
    """(root): the directory that all working directories and sources of the commands have in common; what a new clone's path is."""
    every = commands.select("directory").union(commands.select(paths.dirname(paths.normalise(F.col("file"), F.col("directory")))))
    normal = every.select(paths.normalise(F.col("directory")).alias("path"))
    return normal.agg(F.min("path").alias("low"), F.max("path").alias("high")).select(paths.common_root(F.col("low"), F.col("high")).alias("root"))


def validate(components: DataFrame, wanted: list[str] = ()) -> None:
    """Component names must be there, be unique and include the wanted ones."""
    bad = components.groupBy("name").agg(F.count("*").alias("n")).where("name is null or name = '' or n > 1").orderBy("name").limit(5).collect()
    if bad:
        raise RegistryError(f"empty or repeated component names: {[r.name for r in bad]}")
    known = {r.name for r in components.where(F.col("name").isin(*wanted)).select("name").collect()} if wanted else set()
    if missing := sorted(set(wanted) - known):
        raise RegistryError(f"unknown components: {missing}")


def register_files(stored: DataFrame, found: DataFrame, roots: DataFrame, own_path: str = "") -> DataFrame:
    """stored (id, path, owner) with the new paths of found (path) that a root owns; ids go on from the largest.

    Paths are normalised, the registry's own file is left out, and paths that no root owns are skipped.
    """
    new = found.select(paths.normalise(F.col("path")).alias("path")).distinct().where(F.col("path") != own_path)
    new = longest_prefix_owner(new.join(stored.select("path"), "path", "left_anti"), "path", roots, "root").where("owner is not null")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # one row
    numbered = numbered_rows(new, ["path"], "__n").crossJoin(F.broadcast(last))
    return stored.select("id", "path", "owner").unionByName(numbered.select((F.col("__last") + F.col("__n") + 1).alias("id"), "path", "owner"))


def import_commands(files: DataFrame, prepared: DataFrame) -> DataFrame:
    """files (id, path, ...) with the compile columns of all cleared and those of the prepared sources set; no row goes."""
    cleared = files.drop("driver", "compile_options", "working_directory")
    new = prepared.select(F.col("source").alias("path"), "driver", F.col("options").alias("compile_options"), "working_directory")
    return cleared.join(new, "path", "left")


def replace_configuration(stored: dict[str, DataFrame], components: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The component and file tables of ``stored`` with a configuration taken over whole, or an error and nothing changed.

    Components (name, path) are upserted by path and keep their ids; every file must name a component and have a name and options.
    Compile columns of all stored files are cleared first. New ids go on from the largest.
    """
    bad = components.groupBy("path").agg(F.count("*").alias("n")).where("path is null or path = '' or n > 1").select("path").limit(5).collect()
    if bad or components.isEmpty():
        raise RegistryError(f"empty or repeated component paths: {[r.path for r in bad]}")
    lost = files.join(components.select(F.col("path").alias("component_path")), "component_path", "left_anti")
    if not lost.unionByName(files.where("name is null or name = '' or compile_options is null or compile_options = ''")).isEmpty():
        raise RegistryError("files without a component, a name or options")
    kept = upsert(stored["component"], components, ["path"], "id")
    keyed = files.join(kept.select(F.col("path").alias("component_path"), F.col("id").alias("component_id")), "component_path").drop("component_path")
    cleared = stored["file"].withColumn("compile_options", F.lit(None).cast("string")).withColumn("driver", F.lit(None).cast("string"))
    return stored | {"component": kept, "file": upsert(cleared, keyed, ["component_id", "directory", "name"], "id")}


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """stored with the columns of new set on rows of the same keys, and rows added for new keys with the next ids."""
    rest = [c for c in new.columns if c not in keys]
    old = stored.join(new.select(*keys, F.struct(*rest, F.lit(True).alias("__is")).alias("__new")) if rest else new.select(*keys, F.struct(F.lit(True).alias("__is")).alias("__new")), keys, "left")
    kept = old.select(*(F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in stored.columns))
    last = stored.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__last"))  # one row
    fresh = numbered_rows(new.join(stored.select(*keys), keys, "left_anti"), keys, "__n").crossJoin(F.broadcast(last))
    added = fresh.select((F.col("__last") + F.col("__n") + 1).alias(id_column), *new.columns)
    return kept.unionByName(added, allowMissingColumns=True)


def add_clone(repositories: DataFrame, clones: DataFrame, repository: str, path: str, label: str | None = None, activate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repositories, clones) with a clone of that path upserted, and made the active one if so asked."""
    own = repositories.where(F.col("name") == repository).select("id").limit(1).collect()
    if not own or not path:
        raise RegistryError(f"no repository {repository!r} or no path")
    one = repositories.sparkSession.createDataFrame([(own[0].id, path, label)], "repository_id long, path string, label string")
    after = upsert(clones, one, ["repository_id", "path"], "id")
    return (switch_clone(repositories, after, repository, path) if activate else repositories), after


def split_flat_paths(files: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories, files) of an old registry that had whole paths: files (id, path), components (id, root). Ids of files stay.

    Raises if a path lies in no component or an id isn't positive, and changes nothing.
    """
    owned = cut(longest_prefix_owner(files.withColumn("path", paths.normalise(F.col("path"))), "path", components, "root"))
    if not owned.where("owner is null or id is null or id < 1").isEmpty():
        raise RegistryError("paths outside all components, or ids below 1")
    relative = F.substr(F.col("path"), F.when(F.col("owner") == "/", 2).otherwise(F.length("owner") + 2), F.length("path"))
    parts = owned.join(components.select(F.col("root").alias("owner"), F.col("id").alias("component_id")), "owner")
    parts = parts.select("id", "component_id", paths.dirname(relative).alias("directory"), paths.basename(F.col("path")).alias("name"))
    directories = numbered_rows(parts.select("component_id", "directory").distinct(), ["component_id", "directory"], "__n")
    directories = cut(directories.select((F.col("__n") + 1).alias("directory_id"), "component_id", "directory"))
    return directories, parts.join(directories, ["component_id", "directory"]).select("id", "directory_id", "name")


def join_flat_directories(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(id, path) of an old registry of files (id, directory_id, name) and flat directories (id, path), to be split anew."""
    d = directories.select(F.col("id").alias("directory_id"), F.col("path").alias("__directory"))
    return files.join(d, "directory_id").select("id", paths.normalise(F.concat_ws("/", "__directory", "name")).alias("path"))


def switch_clone(repositories: DataFrame, clones: DataFrame, repository: str, path_or_label: str) -> DataFrame:
    """repositories with the active clone of one switched to the clone of that path or label."""
    own = repositories.where(F.col("name") == repository).select(F.col("id").alias("repository_id"))
    match = clones.join(own, "repository_id", "left_semi").where((F.col("path") == path_or_label) | (F.col("label") == path_or_label)).orderBy("id").limit(1).collect()
    if not match:
        raise RegistryError(f"{repository} has no clone {path_or_label}")
    return repositories.withColumn("active_clone_id", F.when(F.col("name") == repository, F.lit(match[0].id)).otherwise(F.col("active_clone_id")))


def stored_files(files: DataFrame, directories: DataFrame, components: DataFrame, repositories: DataFrame, clones: DataFrame) -> DataFrame:
    """Full path, options, driver and directory of the files that have compile options."""
    c = components.alias("c").join(repositories.alias("r"), F.col("c.repository_id") == F.col("r.id"), "left").join(clones.alias("k"), F.col("r.active_clone_id") == F.col("k.id"), "left")
    c = c.select(F.col("c.id").alias("component_id"), F.col("c.name").alias("component"), paths.effective_root(F.col("c.path"), F.col("k.path"), F.col("c.version"), F.col("r.id").isNotNull()).alias("root"))
    d = directories.select(F.col("id").alias("directory_id"), "component_id", F.col("path").alias("directory"))
    rows = files.where("compile_options is not null").join(d, "directory_id").join(c, "component_id")
    full = F.concat_ws("/", "root", F.when(F.col("directory") != "", F.col("directory")), "name")
    return rows.select("id", full.alias("path"), "component", argv.decode_options(F.col("compile_options")).alias("options"), "driver", "working_directory").orderBy("id")
