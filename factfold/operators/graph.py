"""Graphs of facts: closure, reachability, components, cycles, levels, ancestors.

Loops run on the driver over DataFrames; each round is a join and an aggregation whose new rows are written and read again, and the only
value that comes back is whether there are any. Pairs of nodes are made where they are what is asked for (``closure``, ``pairs_above``,
``dominators``): questions about ancestors in a tree are answered by pointer jumping, in as many rounds as the depth has binary
digits, questions about reachability and cycles by frontiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.operators.lineage import Growing, cut, drop, sized
from factfold.operators.scan import running_sum

#: Rows that a task gets, on average, of a table whose partitions are counted out.
ROWS_OF_A_TASK = 500_000


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """(src, dst, distance): all pairs joined by a path of one edge or more, and the length of a shortest one.

    Path doubling: with all pairs of distance up to n = 2**k known, those of distance n + 1 to 2 n are the pairs of distance n, each gone on by
    a known pair. A shortest path is then made once for each node it has at n steps, and not once for each of its nodes; cycles end by
    themselves. Partitions follow the counted rows, so that what a task holds does not grow with the pairs.
    """
    known = far = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct().withColumn("distance", F.lit(1)))
    n = ends = known.count()
    for k in range(rounds):
        dealt = lambda rows, *by: rows.repartition(1 + (n + ends) // ROWS_OF_A_TASK, *by)  # noqa: E731, B023
        left = dealt(far.select("src", F.col("dst").alias("mid"), F.col("distance").alias("d1")), "mid")
        right = dealt(known.select(F.col("src").alias("mid"), "dst", F.col("distance").alias("d2")), "mid")
        longer = left.join(right.hint("merge"), "mid").select("src", "dst", (F.col("d1") + F.col("d2")).alias("distance"))
        least = dealt(longer, "src", "dst").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
        new = cut(least.join(known.hint("merge"), ["src", "dst"], "left_anti"))
        far = new.where(F.col("distance") == 2 << k)
        known = known.unionByName(new)
        n, ends = n + new.count(), far.count()
        if not ends:
            return known
    raise RuntimeError(f"closure did not settle in {rounds} rounds")


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 10_000) -> DataFrame:
    """(node, depth) of all nodes reached from roots (node), themselves at depth 0: a frontier joined round by round. Only frontiers are
    written, so what is written follows the nodes and not nodes times rounds."""
    steps = cut(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct())
    frontier = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = Growing(frontier)
    n = total = frontier.count()
    for k in range(1, rounds):
        found = sized(frontier, n).join(steps, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(found.join(sized(seen.rows(), total), "node", "left_anti").withColumn("depth", F.lit(k)))
        n = frontier.count()
        if not n:
            drop(steps, frontier)
            return seen.rows()
        seen.add(frontier)
        total += n
    raise RuntimeError(f"reachability did not settle in {rounds} rounds")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return nodes.select("node").distinct().join(reachable(edges, roots, src, dst), "node", "left_anti")


def cycle_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) of all nodes that reach themselves: those of a component of several nodes, and those with an edge to themselves."""
    own = cut(strong_components(edges, src, dst))
    several = own.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    selves = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node"))
    return own.join(several, "component").select("node").union(selves).distinct()


def levels(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 10_000) -> DataFrame:
    """(node, level) of an acyclic graph: the longest way in; the order of levels is topological.

    Nodes leave in waves, each when all ways into it have come from earlier ones; a wave's rows alone are written. What never leaves
    lies on or behind a cycle, and raises.
    """
    steps = cut(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct())
    ways = cut(steps.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("ways")))
    nodes = steps.select("node").union(steps.select("next")).distinct()
    wave = cut(nodes.join(sized(ways), "node", "left_anti").withColumn("level", F.lit(0)))
    n = wave.count()
    done, arrived = Growing(wave), Growing(cut(steps.select("node", F.lit(0).cast("long").alias("came")).limit(0)))
    for k in range(1, rounds):
        came = cut(sized(wave, n).join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.count("*").alias("came")))
        arrived.add(came)
        n = came.count()
        so_far = arrived.rows().join(sized(came.select("node"), n), "node", "left_semi").groupBy("node").agg(F.sum("came").alias("came"))
        wave = cut(sized(so_far, n).join(ways, "node").where("came >= ways").select("node", F.lit(k).alias("level")))
        n = wave.count()
        if not n:
            break
        done.add(wave)
    if done.rows().count() < nodes.count():
        raise RuntimeError("the graph has a cycle")
    return done.rows()


def spread(steps: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, value): the least value of start (node, value) that reaches each node along steps (node, next). Only what got a smaller
    value in a round goes on."""
    at, known = start, Growing(start)
    for _ in range(rounds):
        offered = at.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("value").alias("value"))
        held = known.rows().groupBy("node").agg(F.min("value").alias("held"))
        at = cut(offered.join(held, "node", "left").where("held is null or value < held").select("node", "value"))
        if at.isEmpty():
            return cut(known.rows().groupBy("node").agg(F.min("value").alias("value")))
        known.add(at)
    raise RuntimeError(f"values did not settle in {rounds} rounds")


def chains(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(rings, inner, ways) of the nodes of edges (src, dst) that have one way in and one way out, or None if there are none.

    rings (node, label): those on a cycle of such nodes alone, with its least node. inner (node, last): the others, with the last such node of
    their chain; ways (last, head, tail): what stands before and behind each chain. By pointer jumping, in as many rounds as the
    longest chain has binary digits.
    """
    one = lambda end, other, name: edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n"), F.min(other).alias(name)).where("n = 1").drop("n")
    own = cut(one("src", "dst", "next").join(one("dst", "src", "before"), "node"))
    if own.isEmpty():
        return None
    known = lambda name, flag: own.select(F.col("node").alias(name), F.lit(True).alias(flag))
    own = cut(own.join(known("next", "goes_on"), "next", "left").join(known("before", "came"), "before", "left"))
    state = cut(own.select("node", F.when(F.col("goes_on"), F.col("next")).alias("jump"), F.col("node").alias("last"), F.col("node").alias("least")))
    done, still = None, state.where("jump is not null").count()
    for _ in range(rounds):
        if not still:
            break
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("__jump"), F.col("last").alias("__last"), F.col("least").alias("__least"))
        moved = state.where("jump is not null").join(ahead, "jump").select("node", F.col("__jump").alias("jump"), F.col("__last").alias("last"), F.least("least", "__least").alias("least"), (F.col("__least") < F.col("least")).alias("fell"))
        old, state = state, cut(moved.unionByName(state.where("jump is null").withColumn("fell", F.lit(False))))
        drop(old)
        now = state.where("jump is not null").agg(F.count("*").alias("n"), F.count_if("fell").alias("fell")).first()
        if now.n == still and not now.fell:  # a chain gets shorter in each round; only rings stay
            break
        still = now.n
    else:
        raise RuntimeError(f"chains did not settle in {rounds} rounds")
    inner = state.where("jump is null").select("node", "last")
    heads = own.where("came is null").select("node", F.col("before").alias("head")).join(inner, "node").select("last", "head")
    ways = cut(heads.join(own.select(F.col("node").alias("last"), F.col("next").alias("tail")), "last"))
    return state.where("jump is not null").select("node", F.col("least").alias("label")), inner, ways


def thinned(edges: DataFrame, rounds: int = 1_000) -> tuple[DataFrame, list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """What is left of edges (src, dst) when chains become one edge and nodes without a way in or a way out go, by turns; with the rings and the
    (inner, ways) of ``chains``, first ones first."""
    live, found, contracted = cut(edges.select("src", "dst").distinct()), [], []
    n = live.count()
    for _ in range(rounds):
        if not n:
            return live, found, contracted
        if short := chains(live):
            rings, inner, ways = short
            found.append(rings)
            contracted.append((inner, ways))
            gone = cut(rings.select("node").unionByName(inner.select("node")))
            rest = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            live = cut(rest.unionByName(ways.where("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct())
        old = live
        live = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        drop(old)
        now = live.count()
        if now == n:
            return live, found, contracted
        n = now
    raise RuntimeError(f"chains did not settle in {rounds} rounds")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 1_000) -> DataFrame:
    """(node, component) of all nodes of the edges: component is the smallest node that a node reaches and that reaches it.

    Chains of nodes with one way in and one way out become one edge, and nodes without a way in or a way out are taken away, by turns:
    however long paths, trees and rings are, the rounds follow the digits of their lengths. Of what is left, every node takes, of the nodes that
    reach it, the one of the least hash as its colour, and a flood back from each colour's own node, over edges of one colour, finds the
    component of that node. Found ones leave, and the rest is coloured anew by other hashes. At last the nodes of a chain join the component
    that is at both its ends, if it is one. Neither pairs of nodes nor a closure are made.
    """
    direct = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    live, rings, contracted = thinned(direct.where("src <> dst"))
    labels = rings
    for k in range(rounds):
        if live.isEmpty():
            break
        nodes = live.select(F.col("src").alias("node")).distinct()
        colours = cut(nodes.withColumn("value", F.struct(F.xxhash64("node", F.lit(k)).alias("hash"), F.col("node").alias("name"))))
        colour = spread(live.select(F.col("src").alias("node"), F.col("dst").alias("next")), colours)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("value").alias(f"c{end}"))
        within = cut(live.join(of("src"), "src").join(of("dst"), "dst").where("csrc = cdst").select("src", "dst"))
        back = reachable(within, colour.where("node = value.name"), "dst", "src").select("node").join(colour, "node").select("node", F.col("value.name").alias("label"))
        back = cut(back)
        gone = back.select("node")
        live, rings, more = thinned(live.join(gone, live["src"] == gone["node"], "left_anti").join(gone, live["dst"] == gone["node"], "left_anti"))
        labels, contracted = [*labels, back, *rings], contracted + more
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = direct.select(F.col("src").alias("node")).union(direct.select("dst")).distinct()
    found = direct.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    for more in labels:
        found = found.unionByName(more)
    found = cut(found)
    for inner, ways in reversed(contracted):  # ends without a label are components of their own
        at = lambda end: found.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))  # noqa: E731, B023
        ends = ways.join(at("head"), "head", "left").join(at("tail"), "tail", "left").select("last", F.coalesce("lhead", "head").alias("label"), F.coalesce("ltail", "tail").alias("other"))
        ends = ends.where("label = other").select("last", "label")
        joined = inner.join(ends, "last").select("node", "label")
        found = cut(found.unionByName(joined).unionByName(_missing(ways, found)))
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    own = found.join(least, "label").select("node", "component")
    return nodes.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _missing(ways: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label): nodes that a chain leads back to and that have no label so far."""
    back = ways.where("head = tail").select(F.col("head").alias("node")).distinct()
    return back.join(found, "node", "left_anti").select("node", F.col("node").alias("label"))


def condensed(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst): edges between different components of (node, component), which have no cycle."""
    of = lambda end, name: components.select(F.col("node").alias(end), F.col("component").alias(name))
    both = edges.select(F.col(src).alias("__src"), F.col(dst).alias("__dst")).join(of("__src", "src"), "__src").join(of("__dst", "dst"), "__dst")
    return both.where("src <> dst").select("src", "dst").distinct()


def recursion_groups(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component, size, recursive, level): the group of functions that call each other, whether a node can come back to itself, and the
    level of its group in the order of calls."""
    own = cut(strong_components(edges, src, dst))
    size = own.groupBy("component").agg(F.count("*").alias("size"))
    selves = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node"), F.lit(True).alias("self")).distinct()
    order = levels(condensed(edges, own, src, dst)).withColumnRenamed("node", "component")
    rows = own.join(size, "component").join(selves, "node", "left").join(order, "component", "left")
    return rows.select("node", "component", "size", ((F.col("size") > 1) | F.coalesce("self", F.lit(False))).alias("recursive"), F.coalesce("level", F.lit(0)).alias("level"))


def cycle_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst): edges whose target reaches their source, which are those within a component."""
    direct = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    own = cut(strong_components(direct))
    of = lambda end: own.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    return direct.join(of("src"), "src").join(of("dst"), "dst").where("csrc = cdst").select("src", "dst")


def nearest_ancestor(parents: DataFrame, wanted: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, ancestor, distance) from parents (node, parent) and wanted (node): for each node below a wanted one the nearest such.

    Pointer jumping: after k rounds a node knows its ancestor 2**k steps up and whether a wanted one came before.
    """
    mark = wanted.select(F.col("node").alias("up"), F.lit(True).alias("__wanted")).distinct()
    state = parents.where("parent is not null").select("node", F.col("parent").alias("up")).distinct().join(mark, "up", "left")
    state = cut(state.select("node", "up", F.when(F.col("__wanted"), F.col("up")).alias("ancestor"), F.when(F.col("__wanted"), F.lit(1)).alias("distance")))
    for k in range(rounds):
        seeking = F.col("ancestor").isNull() & F.col("up").isNotNull()
        if state.where(seeking).isEmpty():
            return state.where("ancestor is not null").select("node", "ancestor", "distance")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("ancestor").alias("__a"), F.col("distance").alias("__d"))
        moved = state.where(seeking).join(above, "up", "left").select("node", F.col("__up").alias("up"), F.col("__a").alias("ancestor"), (F.col("__d") + (1 << k)).alias("distance"))
        state = cut(state.where(~seeking).unionByName(moved))
    raise RuntimeError(f"ancestors did not settle in {rounds} rounds")


def depths(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, ancestors): how many ancestors each node of a tree (node, parent) has."""
    state = cut(parents.where("parent is not null").select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("ancestors")).distinct())
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            return state.select("node", "ancestors")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("ancestors").alias("__n"))
        state = cut(state.join(above, "up", "left").select("node", F.col("__up").alias("up"), (F.col("ancestors") + F.coalesce("__n", F.lit(0))).alias("ancestors")))
    raise RuntimeError(f"depths did not settle in {rounds} rounds")


def intervals(parents: DataFrame, others: DataFrame) -> DataFrame | None:
    """(node, first, last): numbers of the nodes of a forest (node, parent) and of the single nodes others (node), such that the nodes
    below a node are those whose first lies after its first and up to its last. None where a node has two parents or is above itself.

    By pointer jumping over the nodes: after k rounds a node knows its ancestor 2**k steps up and how many nodes are less than 2**k steps
    below it. A node's first is then the sum, over the way to it, of one and the sizes of the earlier siblings, by pointer jumping again.
    """
    up = cut(parents.where("node is not null and parent is not null").select("node", "parent").distinct())
    every = up.select("node").unionByName(up.select(F.col("parent").alias("node"))).unionByName(others.select("node").where("node is not null")).distinct()
    own = cut(every.join(up.hint("merge"), "node", "left"))
    n = own.count()
    if n != every.count():
        return None
    state, steps = own.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), 1
    while not (seeking := state.where("up is not null")).isEmpty():
        if steps > n:  # no way up is longer than all nodes
            return None
        above = seeking.select(F.col("node").alias("up"), F.col("up").alias("__up"))
        moved = seeking.join(sized(above, n), "up", "left").select("node", F.col("__up").alias("up"), "size")
        more = seeking.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("__more"))
        both = state.where("up is null").unionByName(moved).join(sized(more, n), "node", "left")
        state = cut(both.select("node", "up", (F.col("size") + F.coalesce("__more", F.lit(0))).alias("size")))
        steps *= 2
    siblings = running_sum(own.join(sized(state.select("node", "size"), n), "node"), "parent", ["node"], "size", "__before")
    state = cut(siblings.select("node", F.col("parent").alias("up"), (F.col("__before") + 1).alias("first"), "size"))
    while not (seeking := state.where("up is not null")).isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("first").alias("__first"))
        moved = seeking.join(sized(above, n), "up").select("node", F.col("__up").alias("up"), (F.col("first") + F.col("__first")).alias("first"), "size")
        state = cut(state.where("up is null").unionByName(moved))
    return state.select("node", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def chain_ends(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, last, hops) of links (node, next), one per node: where following them ends, by pointer jumping. Cycles raise."""
    state = cut(links.where("next is not null").select("node", F.col("next").alias("last"), F.lit(1).cast("long").alias("hops")))
    for _ in range(rounds):
        above = state.select(F.col("node").alias("last"), F.col("last").alias("__last"), F.col("hops").alias("__hops"))
        joined = cut(state.join(above, "last", "left"))
        if joined.where("__last is not null").isEmpty():
            return state
        state = cut(joined.select("node", F.coalesce("__last", "last").alias("last"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops")))
    raise RuntimeError("the links have a cycle")


def pairs_above(parents: DataFrame, starts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, ancestor, distance) for the nodes of starts (node) alone: each walks up, one row per step."""
    steps = cut(parents.where("parent is not null").select(F.col("node").alias("ancestor"), "parent").distinct())
    at, out = cut(starts.select("node", F.col("node").alias("ancestor")).distinct()), None
    for k in range(1, rounds):
        at = cut(sized(at).join(steps, "ancestor").select("node", F.col("parent").alias("ancestor")))
        if at.isEmpty():
            return out if out is not None else at.withColumn("distance", F.lit(k))
        level = at.withColumn("distance", F.lit(k))
        out = level if out is None else out.unionByName(level)
    raise RuntimeError(f"walks did not end in {rounds} rounds")


def dominators(edges: DataFrame, root, src: str = "src", dst: str = "dst", rounds: int = 1_000) -> DataFrame:
    """(node, dominator) for the nodes reached from root: d dominates n if every way from root to n passes d.

    A dominator lies on each way, so also on a shortest one: the nodes of one shortest way are the candidates, and those that do not
    dominate all predecessors go, until none goes.
    """
    reach = cut(reachable(edges, edges.sparkSession.createDataFrame([(root,)], ["node"]), src, dst))
    steps = edges.select(F.col(src).alias("p"), F.col(dst).alias("node")).distinct().join(sized(reach.select(F.col("node").alias("p"), F.col("depth").alias("__d"))), "p").where(F.col("node") != F.lit(root))
    steps = cut(steps)
    tree = steps.join(sized(reach), "node").where("depth = __d + 1").groupBy("node").agg(F.min("p").alias("parent"))
    own = reach.select("node", F.col("node").alias("dominator"))
    doms = cut(pairs_above(tree, reach).select("node", F.col("ancestor").alias("dominator")).unionByName(own))
    ways = sized(cut(steps.groupBy("node").agg(F.count("*").alias("__ways"))))
    size = doms.count()
    for _ in range(rounds):
        held = steps.select("p", "node").join(sized(doms.withColumnRenamed("node", "p"), size), "p").groupBy("node", "dominator").agg(F.count("*").alias("__held"))
        stays = held.join(ways, "node").where("__held = __ways").select("node", "dominator")
        doms = cut(doms.where("node <> dominator").join(sized(stays, size), ["node", "dominator"], "left_semi").unionByName(own))
        now = doms.count()
        if now == size:
            return doms
        size = now
    raise RuntimeError("dominators did not settle")
