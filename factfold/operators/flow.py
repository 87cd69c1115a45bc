"""Control flow: natural loops and facts that hold on all ways.

Edges (src, dst) join blocks; blocks of all functions are one graph. Loops over DataFrames write frontiers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.operators.graph import dominators, reachable
from factfold.operators.lineage import Growing, cut, sized


def natural_loops(edges: DataFrame, root, src: str = "src", dst: str = "dst", rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(members, loops) of the blocks reached from root.

    An edge is a back edge if its target dominates its source; edges of a cycle that can be entered in two places are none. members (header,
    node) are a header, the sources of its back edges and all that reach those without passing the header; back edges to one header make
    one loop. loops (header, parent, depth, size): the loop right around it, how many loops it is in (1: itself only) and its blocks.
    """
    doms = cut(dominators(edges, root, src, dst))
    reached = doms.where("node = dominator").select("node")
    steps = edges.select(F.col(src).alias("before"), F.col(dst).alias("node")).distinct()
    steps = cut(steps.join(sized(reached.withColumnRenamed("node", "before")), "before", "left_semi"))
    back = steps.join(sized(doms), (steps["before"] == doms["node"]) & (steps["node"] == doms["dominator"])).select(doms["dominator"].alias("header"), doms["node"].alias("node"))
    heads = back.select("header", F.col("header").alias("node"))
    at = cut(back.unionByName(heads).distinct())
    seen = Growing(at)
    n = total = at.count()
    for _ in range(rounds):
        found = sized(at.where("node <> header"), n).join(steps, "node").select("header", F.col("before").alias("node")).distinct()
        at = cut(found.join(sized(seen.rows(), total), ["header", "node"], "left_anti"))
        n = at.count()
        if not n:
            break
        seen.add(at)
        total += n
    else:
        raise RuntimeError(f"loops did not settle in {rounds} rounds")
    members = cut(seen.rows())
    size = cut(members.groupBy("header").agg(F.count("*").alias("size")))
    n = size.count()  # of loops, which all joins below have one row each of
    inside = members.join(sized(size.select(F.col("header").alias("node")), n), "node").select(F.col("node").alias("header"), F.col("header").alias("outer"))
    depth = cut(inside.groupBy("header").agg(F.count("*").alias("depth")))
    around = inside.where("header <> outer").join(sized(depth.select(F.col("header").alias("outer"), F.col("depth").alias("outer_depth")), n), "outer")
    parent = around.groupBy("header").agg(F.max_by("outer", "outer_depth").alias("parent"))
    return members, size.join(sized(depth, n), "header").join(sized(parent, n), "header", "left").select("header", "parent", "depth", "size")


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reachable(edges, starts.select(F.col("block").alias("node"))).select(F.col("node").alias("block"))


def lacking(edges: DataFrame, starts: DataFrame, gains: DataFrame, loses: DataFrame, rounds: int = 10_000, reached: DataFrame | None = None) -> DataFrame:
    """(block, item): the items that some way from a start comes to the block without.

    starts (block, item) name the entries with the items asked for there, which nothing holds yet; gains and loses (block, item) are what
    holds or is gone when a block is left, whatever was before. An item holds at a block if it holds at the end of all blocks before
    it: the meet is an intersection. What doesn't hold is then a union, which grows by frontiers from the entries and the losing blocks; so
    the greatest solution is reached, also around loops. reached (block) are the blocks reached from starts, if they are known already.
    """
    steps = cut(edges.select(F.col("src").alias("block"), F.col("dst").alias("after")).distinct())
    if reached is None:
        reached = _reached(edges, starts)
    lost = loses.join(sized(reached), "block", "left_semi").join(sized(steps), "block").select(F.col("after").alias("block"), "item")
    at = cut(starts.select("block", "item").unionByName(lost).distinct())
    seen, gains = Growing(at), sized(cut(gains.select("block", "item")))
    n = total = at.count()
    for _ in range(rounds):
        found = sized(at.join(gains, ["block", "item"], "left_anti"), n).join(steps, "block").select(F.col("after").alias("block"), "item").distinct()
        at = cut(found.join(sized(seen.rows(), total), ["block", "item"], "left_anti"))
        n = at.count()
        if not n:
            return seen.rows()
        seen.add(at)
        total += n
    raise RuntimeError(f"items did not settle in {rounds} rounds")


def guarded(edges: DataFrame, starts: DataFrame, gains: DataFrame, loses: DataFrame, accesses: DataFrame) -> DataFrame:
    """accesses (block, item, ...) of reached blocks with is_guarded: whether the item is held there on all ways; accesses come before what
    their block gains or loses."""
    reached = _reached(edges, starts)
    open_ = lacking(edges, starts, gains, loses, reached=reached).withColumn("is_guarded", F.lit(False))
    return accesses.join(sized(reached), "block", "left_semi").join(sized(open_), ["block", "item"], "left").withColumn("is_guarded", F.coalesce("is_guarded", F.lit(True)))
