"""Inventories over syntax nodes and facts: calls, literals, temporaries, specialisations, computed jumps; guarded look-ups and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.operators.graph import nearest_ancestor

#: Kinds of nodes that are calls, and how each is written.
CALLS = {"CallExpr": "plain", "CXXMemberCallExpr": "member", "CXXOperatorCallExpr": "operator", "UserDefinedLiteral": "literal"}


def calls(nodes: DataFrame) -> DataFrame:
    """(id, kind, family, has_written_arguments) of nodes (id, kind) of all kinds that are calls; a literal's arguments are not in the source."""
    family = F.create_map(*(F.lit(x) for pair in CALLS.items() for x in pair))[F.col("kind")]
    return nodes.where(F.col("kind").isin(*CALLS)).select("id", "kind", family.alias("family"), (F.col("kind") != "UserDefinedLiteral").alias("has_written_arguments"))


def written_literals(nodes: DataFrame, literal: str, wrapper: str, transparent: list[str]) -> DataFrame:
    """(id) of literals that don't come from a template argument: the nearest node around them that is of no transparent kind is no wrapper.

    nodes (id, parent_id, kind).
    """
    solid = nodes.where(~F.col("kind").isin(*transparent)).select(F.col("id").alias("node"))
    near = nearest_ancestor(nodes.select(F.col("id").alias("node"), F.col("parent_id").alias("parent")), solid)
    wrapped = near.join(nodes.where(F.col("kind") == wrapper).select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("id"))
    return nodes.where(F.col("kind") == literal).select("id").join(wrapped, "id", "left_anti")


def count_inside(nodes: DataFrame, counted: list[str], owner: str) -> DataFrame:
    """(id, n): how many nodes of the counted kinds each node of the owner kind is the nearest such around; owners of none have 0."""
    owners = nodes.where(F.col("kind") == owner).select("id")
    near = nearest_ancestor(nodes.select(F.col("id").alias("node"), F.col("parent_id").alias("parent")), owners.select(F.col("id").alias("node")))
    inside = near.join(nodes.where(F.col("kind").isin(*counted)).select(F.col("id").alias("node")), "node", "left_semi").groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n"))
    return owners.join(inside, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def specialisations(facts: DataFrame, arguments: DataFrame, records: DataFrame, template: str, position: int, record: str, pointer: bool = True) -> DataFrame:
    """(id) of specialisations (id, template) of a template whose argument (id, position, type_id, is_pointer) of that position is, or points
    to, the record (type_id, name) of that name."""
    meant = records.where(F.col("name") == record).select("type_id")
    there = arguments.where((F.col("position") == position) & (F.col("is_pointer") == pointer)).join(meant, "type_id", "left_semi")
    return facts.where(F.col("template") == template).select("id").join(there, "id", "left_semi")


def computed_jumps(jumps: DataFrame, addresses: DataFrame) -> DataFrame:
    """Edges (function, src, dst) of jumps (function, id) through a value, each of which may go to every label of its function whose address is
    taken (function, label).

    Every jump has an edge to a node of its function (dst null), and that node has one to each label (src null): as many edges as jumps and
    labels and not as pairs of them, with the same ways. Functions without such labels or without such jumps have none.
    """
    taken, of = addresses.select("function", "label").distinct(), jumps.select("function", "id")
    into = of.join(taken, "function", "left_semi").select("function", F.col("id").alias("src"), F.lit(None).cast(taken.schema["label"].dataType).alias("dst"))
    out = taken.join(of, "function", "left_semi").select("function", F.lit(None).cast(of.schema["id"].dataType).alias("src"), F.col("label").alias("dst"))
    return into.unionByName(out)


def fail_fast(rows: DataFrame, group: str, order: str, error: str) -> tuple[DataFrame, DataFrame]:
    """(kept, failures): rows of each group before its first one with an error, and those first ones; what comes after goes.

    order is different within a group. A null group is a group like others.
    """
    first = rows.where(F.col(error).isNotNull()).groupBy(F.col(group).alias("__group")).agg(F.min(order).alias("__first"))
    both = rows.join(first, F.col(group).eqNullSafe(F.col("__group")), "left")
    kept = both.where(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).select(*rows.columns)
    return kept, both.where(F.col(order) == F.col("__first")).select(*rows.columns)


def find_ids(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """wanted (usr, ...) with id and error: an empty or null usr is an error, one that no symbol (id, usr) has gives null without one."""
    named = F.coalesce(F.col("usr"), F.lit("")) != ""
    found = symbols.where("usr <> ''").groupBy(F.col("usr").alias("__usr")).agg(F.min("id").alias("id"))
    both = wanted.join(found, F.when(named, F.col("usr")) == F.col("__usr"), "left")
    return both.select(*wanted.columns, "id", F.when(~named, "a symbol needs a usr").alias("error"))


def find_nodes(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """wanted (id, node, ...) with found: whether a symbol (id, node) has both; an id of another node is not found."""
    there = symbols.select(F.col("id").alias("__id"), F.col("node").alias("__node")).distinct()
    both = wanted.join(there, (F.col("id") == F.col("__id")) & (F.col("node") == F.col("__node")), "left")
    return both.select(*wanted.columns, F.col("__id").isNotNull().alias("found"))
