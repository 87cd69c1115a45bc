"""Names to declarations: the nearest enclosing scope that declares a name, and what the declaration found there stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.operators.graph import ROWS_OF_A_TASK, chain_ends, intervals, nearest_ancestor
from factfold.operators.lineage import Growing, cut, sized
from factfold.operators.scan import running_max, running_sum


def declaring_scopes(asked: DataFrame, scopes: DataFrame, declared: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(scope, name, holder): for each pair asked (scope, name) the nearest scope, itself first, that declares (scope, name) the name.

    Scopes that form a forest are numbered, and the pairs asked are placed once among the scopes that declare their name. Scopes with several
    parents or around themselves have no such numbers: then pairs walk up (rounds: at most the depth of scopes).
    """
    up = cut(scopes.where("parent is not null").select("scope", "parent").distinct())
    declared = cut(declared.select("scope", "name").where("scope is not null and name is not null").distinct())
    asked = cut(asked.select("scope", "name").where("scope is not null and name is not null").distinct())
    placed = intervals(up.withColumnRenamed("scope", "node"), declared.select(F.col("scope").alias("node")))
    return _climbed(asked, up, declared, rounds) if placed is None else _innermost(asked, placed, declared)


def _innermost(asked: DataFrame, placed: DataFrame, declared: DataFrame) -> DataFrame:
    """Holders by scans over (name, place): a scope that declares a name is a region of places, from its own to the last below it, and regions of
    a name are nested or apart. After a region begins it is the innermost, after it ends the one around it is; so the last beginning or end
    before a pair asked tells its holder.
    """
    placed = sized(placed.withColumnRenamed("node", "scope"))
    regions = cut(declared.join(placed, "scope"))
    places = cut(asked.join(placed.select("scope", "first"), "scope"))
    begins, asks, ends = F.col("first") * 3, F.col("first") * 3 + 1, F.col("last") * 3 + 2
    steps = regions.select("name", "scope", "first", "last", begins.alias("at"), F.lit(1).alias("step")).unionByName(regions.select("name", "scope", "first", "last", ends.alias("at"), F.lit(-1).alias("step")))
    inside = cut(running_sum(steps, "name", ["at"], "step", "level").where("step = 1"))
    # the region around one is the last that began a level further out
    key = lambda level: F.struct(F.col("name").alias("name"), level.alias("level"))
    level, region = F.col("level"), F.struct("first", F.col("scope").alias("top"))
    keyed = inside.select("name", "scope", "first", "last", key(level).alias("key"), F.lit(None).cast(inside.select(region.alias("r")).schema["r"].dataType).alias("begun"))
    around = running_max(keyed.unionByName(inside.select("name", "scope", "first", "last", key(level + 1).alias("key"), region.alias("begun"))), "key", ["first"], "begun", "around")
    around = around.where("begun is null").select("name", "first", "last", F.col("around.top").alias("top"))
    # of regions that end at one place the outermost counts
    ended = around.groupBy("name", "last").agg(F.min_by("top", "first").alias("top")).select("name", ends.alias("at"), "top")
    told = regions.select("name", begins.alias("at"), F.col("scope").alias("top")).unionByName(ended)
    told = told.select("name", "at", F.lit(None).cast(asked.schema["scope"].dataType).alias("scope"), F.struct("at", "top").alias("event"))
    pairs = places.select("name", asks.alias("at"), "scope", F.lit(None).cast(told.schema["event"].dataType).alias("event"))
    ranges = 1 + (places.count() + 2 * regions.count()) // ROWS_OF_A_TASK
    found = running_max(pairs.unionByName(told), "name", ["at"], "event", "before", ranges).where("event is null")
    return found.select("scope", "name", F.col("before.top").alias("holder")).where("holder is not null")


def _climbed(asked: DataFrame, up: DataFrame, declared: DataFrame, rounds: int) -> DataFrame:
    """Holders by walking up: pairs that are asked or passed are gathered by frontiers, each once however many uses ask through it; then
    pointer jumping over the pairs finds the holders."""
    at = asked
    seen = Growing(at)
    for _ in range(rounds):
        above = at.join(declared, ["scope", "name"], "left_anti").join(up, "scope").select(F.col("parent").alias("scope"), "name").distinct()
        at = cut(above.join(seen.rows(), ["scope", "name"], "left_anti"))
        if at.isEmpty():
            break
        seen.add(at)
    else:
        raise RuntimeError(f"scopes are deeper than {rounds}")
    pairs = cut(seen.rows())
    pair = lambda scope: F.struct(F.col(scope).alias("scope"), F.col("name").alias("name"))
    own = pairs.join(declared, ["scope", "name"], "left_semi")
    links = pairs.join(own, ["scope", "name"], "left_anti").join(up, "scope").select(pair("scope").alias("node"), pair("parent").alias("parent"))
    near = nearest_ancestor(links, own.select(pair("scope").alias("node")))
    return own.select("scope", "name", F.col("scope").alias("holder")).unionByName(near.select("node.scope", "node.name", F.col("ancestor.scope").alias("holder")))


def resolve_names(uses: DataFrame, scopes: DataFrame, declarations: DataFrame, shadows: DataFrame) -> DataFrame:
    """(use, holder, found, referred) of uses (use, scope, name), a row per declaration that the holder has of the name.

    scopes (scope, parent); declarations (declaration, scope, name); shadows (shadow, target), one target each, where the target may be
    a shadow again. found is the declaration that look-up finds, referred the one at the end of its shadows; names that no enclosing
    scope declares have nulls. Shadows in a circle raise.
    """
    holders = declaring_scopes(uses, scopes, declarations)
    ends = chain_ends(shadows.select(F.col("shadow").alias("node"), F.col("target").alias("next"))).select(F.col("node").alias("found"), "last")
    held = declarations.select(F.col("scope").alias("holder"), "name", F.col("declaration").alias("found")).join(ends, "found", "left")
    referred = F.coalesce("last", "found").alias("referred")
    known = holders.join(held, ["holder", "name"]).select("scope", "name", "holder", "found", referred)  # so that uses are shuffled once
    return uses.join(known, ["scope", "name"], "left").select("use", "holder", "found", "referred")
