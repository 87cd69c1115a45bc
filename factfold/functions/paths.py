"""Path functions: parts, normal form, versions, ownership prefixes, common roots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a last path segment that is a version.
VERSION = r"^v?[0-9]+([._-][0-9]+)*$"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, however often f names it: what stands in lambdas is not shared, so places multiply."""
    return F.transform(F.array(value), f)[0]


def dirname(path: Column) -> Column:
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(cut != "", cut).when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot; empty for names without one and for dot files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normalise(path: Column, base: Column | None = None) -> Column:
    """Absolute if a base is given, without empty, ``.`` and ``..`` segments. Links need a file system and stay."""
    whole = path if base is None else once(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat_ws("/", base, p)))

    def normal(whole: Column) -> Column:
        absolute = whole.startswith("/")

        def keep(stack: Column, s: Column) -> Column:
            up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
            bare = F.coalesce(F.get(stack, F.size(stack) - 1), F.lit("..")) == ".."  # nothing left to go up from
            return F.when(s.isin("", "."), stack).when((s == "..") & ~bare, up).when((s == "..") & absolute, stack).otherwise(F.array_append(stack, s))

        joined = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), keep), "/")
        return once(joined, lambda j: F.when(absolute, F.concat(F.lit("/"), j)).when(j == "", F.lit(".")).otherwise(j))

    return once(whole, normal)


def version_key(version: Column) -> Column:
    """Numbers of a version, comparable as arrays; parts that are no numbers count as zero."""
    parts = F.split(F.regexp_replace(version, "^v", ""), "[._-]")
    return F.transform(parts, lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))


def split_version(path: Column) -> Column:
    """struct(base, version) of a path whose last segment is a version, else (path, null)."""
    is_version = basename(path).rlike(VERSION)
    return F.struct(F.when(is_version, dirname(path)).otherwise(path).alias("base"), F.when(is_version, basename(path)).alias("version"))


def prefixes(path: Column) -> Column:
    """Every ancestor directory of an absolute path, and the path itself: ['/', '/a', '/a/b'] for '/a/b'."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.concat(F.array(F.lit("/")), F.when(F.size(parts) > 0, ancestors).otherwise(F.array().cast("array<string>")))


def portable(path: Column, root: Column, name: Column) -> Column:
    """Below the root: ``<name>/rest``; elsewhere the path."""
    label = F.concat(F.lit("<"), name, F.lit(">"))
    return once(path, lambda p: F.when(p == root, label).when(p.startswith(F.concat(root, F.lit("/"))), F.concat(label, F.substr(p, F.length(root) + 1, F.length(p)))).otherwise(p))


def effective_root(path: Column, clone: Column, version: Column, has_repository: Column) -> Column:
    """A relative path of a repository with an active clone is below the clone, unless it is still to be expanded."""
    anchored = has_repository & ~path.startswith("/") & clone.isNotNull() & ~path.contains("<") & ~path.contains("$")
    root = F.when(anchored, F.concat_ws("/", clone, F.when(path != "", path))).otherwise(path)
    return F.when(version.isNotNull() & (version != ""), F.concat_ws("/", root, version)).otherwise(root)


def common_root(least: Column, most: Column) -> Column:
    """The longest common directory of all paths between the least and the greatest of them."""
    a, b = F.split(least, "/"), F.split(most, "/")
    same = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("parts")), lambda s, p: F.struct((s["on"] & p["a"].eqNullSafe(p["b"])).alias("on"), F.when(s["on"] & p["a"].eqNullSafe(p["b"]), F.array_append(s["parts"], p["a"])).otherwise(s["parts"]).alias("parts")))
    return F.array_join(same["parts"], "/")
