"""Structural matchers over nodes (id, parent_id, kind, ...).

A matcher is a function from the node table to the ids that match. Narrowing matchers are column predicates; traversal matchers are
semi or anti joins on the parent column, on edges with a role and a position, or on what frontiers and pointer jumping find along the
parents. No table of all ancestors is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.operators.graph import nearest_ancestor, pairs_above, reachable


class Tree:
    """A node table, with edges (source_id, destination_id, kind, position) between nodes if matchers ask for them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame | None = None):
        self.nodes, self.edges = nodes, edges

    @property
    def parents(self) -> DataFrame:
        return self.nodes.where("parent_id is not null").select(F.col("id").alias("node"), F.col("parent_id").alias("parent"))


Matcher = Callable[[Tree], DataFrame]


def where(condition: Column | str) -> Matcher:
    return lambda t: t.nodes.where(condition).select("id")


def kind(*kinds: str) -> Matcher:
    return where(F.col("kind").isin(*kinds))


def all_of(*matchers: Matcher) -> Matcher:
    def run(t: Tree) -> DataFrame:
        out = matchers[0](t)
        for m in matchers[1:]:
            out = out.join(m(t), "id", "left_semi")
        return out

    return run


def any_of(*matchers: Matcher) -> Matcher:
    def run(t: Tree) -> DataFrame:
        out = matchers[0](t)
        for m in matchers[1:]:
            out = out.unionByName(m(t))
        return out.distinct()

    return run


def unless(matcher: Matcher) -> Matcher:
    return lambda t: t.nodes.select("id").join(matcher(t), "id", "left_anti")


def has(inner: Matcher) -> Matcher:
    """A direct child matches."""

    def run(t: Tree) -> DataFrame:
        parents = t.nodes.join(inner(t), "id", "left_semi").where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
        return t.nodes.select("id").join(parents, "id", "left_semi")

    return run


def has_parent(outer: Matcher) -> Matcher:
    return lambda t: t.nodes.join(outer(t).select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")


def has_descendant(inner: Matcher) -> Matcher:
    """One row per ancestor of a match at any depth: a frontier goes up, and what was seen is left out."""

    def run(t: Tree) -> DataFrame:
        direct = t.nodes.join(inner(t), "id", "left_semi").where("parent_id is not null").select(F.col("parent_id").alias("node"))
        return reachable(t.parents, direct, "node", "parent").select(F.col("node").alias("id"))

    return run


def has_ancestor(outer: Matcher) -> Matcher:
    return lambda t: nearest_ancestor(t.parents, outer(t).select(F.col("id").alias("node"))).select(F.col("node").alias("id"))


def related(kind: str, inner: Matcher, position: int | None = None, reverse: bool = False) -> Matcher:
    """Nodes with an edge of that kind (at that position) to a match, or from one."""
    here, there = ("destination_id", "source_id") if reverse else ("source_id", "destination_id")

    def run(t: Tree) -> DataFrame:
        own = t.edges.where(F.col("kind") == kind)
        own = own if position is None else own.where(F.col("position") == position)
        return own.join(inner(t).select(F.col("id").alias(there)), there, "left_semi").select(F.col(here).alias("id")).distinct()

    return run


def has_parameter(position: int, inner: Matcher) -> Matcher:
    return related("parameter", inner, position)


def has_argument(position: int, inner: Matcher) -> Matcher:
    return related("argument", inner, position)


def callee(inner: Matcher) -> Matcher:
    return related("callee", inner)


def returns(inner: Matcher) -> Matcher:
    return related("return_type", inner)


def of_class(inner: Matcher) -> Matcher:
    return related("method_of", inner)


def parameter_exists(position: int) -> Matcher:
    """Nodes that have a parameter at that position, whatever it is."""
    return lambda t: t.edges.where((F.col("kind") == "parameter") & (F.col("position") == position)).select(F.col("source_id").alias("id")).distinct()


def for_each_descendant(tree: Tree, outer: Matcher, inner: Matcher) -> DataFrame:
    """(ancestor, descendant, distance) with both bound: one row per pair. Only matches of the inner matcher walk up."""
    walks = pairs_above(tree.parents, inner(tree).select(F.col("id").alias("node"))).withColumnRenamed("node", "descendant")
    return walks.join(outer(tree).select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("ancestor", "descendant", "distance")


def bind(tree: Tree, matcher: Matcher, *columns: str) -> DataFrame:
    return tree.nodes.join(matcher(tree), "id", "left_semi").select("id", *columns)


def prune(tree: Tree, roots: Matcher) -> DataFrame:
    """Nodes outside the subtrees of the matching roots."""
    gone = roots(tree).distinct()
    below = nearest_ancestor(tree.parents, gone.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    return tree.nodes.join(gone.unionByName(below).distinct(), "id", "left_anti")


def visible(nodes: DataFrame, implicit: bool = False, instantiations: bool = True) -> DataFrame:
    """Nodes as a visitor sees them: implicit ones only if asked for, those of template instantiations unless asked not to."""
    out = nodes if implicit else nodes.where(~F.coalesce(F.col("is_implicit").cast("boolean"), F.lit(False)))
    return out if instantiations else out.where(~F.coalesce(F.col("is_instantiation").cast("boolean"), F.lit(False)))


def as_spelled(tree: Tree, implicit: Column | str = "is_implicit") -> DataFrame:
    """Explicit nodes, each below its nearest explicit ancestor."""
    hidden = (F.expr(implicit) if isinstance(implicit, str) else implicit).cast("boolean")
    shown = tree.nodes.where(~F.coalesce(hidden, F.lit(False)))
    near = nearest_ancestor(tree.parents, shown.select(F.col("id").alias("node"))).select(F.col("node").alias("id"), F.col("ancestor").alias("parent_id"))
    return shown.drop("parent_id").join(near, "id", "left")


def jump_targets(tree: Tree, jumps: dict[str, list[str]]) -> DataFrame:
    """(id, target): for each jump kind the nearest enclosing node of the kinds that it leaves or repeats."""
    out = None
    for jump, targets in jumps.items():
        wanted = tree.nodes.where(F.col("kind").isin(*targets)).select(F.col("id").alias("node"))
        near = nearest_ancestor(tree.parents, wanted).select(F.col("node").alias("id"), F.col("ancestor").alias("target"))
        own = near.join(tree.nodes.where(F.col("kind") == jump).select("id"), "id", "left_semi")
        out = own if out is None else out.unionByName(own)
    return out


def preorder(tree: Tree, order: str = "id") -> DataFrame:
    """The nodes with ``path``, the chain of order values from the root: sorting by it visits parents before children."""
    up = pairs_above(tree.parents, tree.nodes.select(F.col("id").alias("node")))
    named = up.join(tree.nodes.select(F.col("id").alias("ancestor"), F.col(order).alias("__o")), "ancestor")
    lists = named.groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "__o"))).alias("__up"))
    return tree.nodes.join(lists, "id", "left").withColumn("path", F.concat(F.coalesce(F.transform("__up", lambda x: x["__o"]), F.array().cast(f"array<{tree.nodes.schema[order].dataType.simpleString()}>")), F.array(order))).drop("__up")


def visit_until(tree: Tree, stop: Column, order: str = "id") -> DataFrame:
    """What a preorder visit sees that is left at the first node for which ``stop`` holds, that node included."""
    seen = preorder(tree, order)
    first = seen.where(stop).agg(F.min("path").alias("__last"))  # one row
    return seen.crossJoin(F.broadcast(first)).where("__last is null or path <= __last").drop("__last")
