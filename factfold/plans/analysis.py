"""Registered queries of program analysis: recursion groups, loops, held locks, stacks of open regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.operators import flow, graph, scan
from factfold.plans.registered import big, query

# Calls: three parts in a row call each other round, but every fourth such group is a chain; the first of a group calls into a later group.
_CALLS = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS p FROM part),
e AS MATERIALIZED (SELECT p AS src, CASE WHEN p % 3 < 2 THEN p + 1 ELSE p - 2 END AS dst FROM p, n WHERE (p % 3 < 2 AND p + 1 < n) OR (p % 3 = 2 AND (p // 3) % 4 <> 0)
  UNION SELECT p, 2 * p + 3 FROM p, n WHERE p % 3 = 0 AND 2 * p + 3 < n UNION SELECT p, p FROM p WHERE p % 30 = 4),
c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
g AS MATERIALIZED (SELECT p AS node, least(p, coalesce((SELECT min(c.dst) FROM c JOIN c b ON c.dst = b.src AND c.src = b.dst WHERE c.src = p), p)) AS component FROM p WHERE p IN (SELECT src FROM e) OR p IN (SELECT dst FROM e))"""


def _calls(t):
    n = F.broadcast(t.part.agg(F.count("*").alias("n")))  # one row
    p = t.part.select(F.col("p_partkey").alias("p")).crossJoin(n)
    turn = F.when(F.col("p") % 3 < 2, F.col("p") + 1).otherwise(F.col("p") - 2)
    ring = p.where(((F.col("p") % 3 < 2) & (F.col("p") + 1 < F.col("n"))) | ((F.col("p") % 3 == 2) & (F.floor(F.col("p") / 3) % 4 != 0)))
    later = p.where((F.col("p") % 3 == 0) & (2 * F.col("p") + 3 < F.col("n"))).select("p", 2 * F.col("p") + 3)
    own = p.where(F.col("p") % 30 == 4).select("p", "p")
    return ring.select(F.col("p").alias("src"), turn.alias("dst")).union(later).union(own).distinct()


@query(f"""{_CALLS}, d AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN g a ON a.node = e.src JOIN g b ON b.node = e.dst WHERE a.component <> b.component),
l(node, level) AS (SELECT DISTINCT component, 0 FROM g UNION SELECT d.dst, level + 1 FROM l JOIN d ON d.src = l.node)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size, (count(*) OVER (PARTITION BY component) > 1 OR node IN (SELECT src FROM e WHERE src = dst)) AS recursive,
  (SELECT max(level) FROM l WHERE l.node = component)::BIGINT AS level FROM g""")
def recursion_groups(t):
    """Functions that call each other in a round, and the order of their groups."""
    return graph.recursion_groups(_calls(t)).withColumn("level", big("level"))


# Blocks: ten of a function in a row; even functions jump back from the fifth, eighth and ninth block, every third enters its sixth early.
_BLOCKS = """WITH RECURSIVE p AS (SELECT p_partkey AS p, p_partkey % 10 AS k, p_partkey // 10 AS f FROM part), e AS MATERIALIZED (SELECT p AS src, p + 1 AS dst FROM p WHERE k < 9
  UNION SELECT p, p - 2 FROM p WHERE k = 4 AND f % 2 = 0 UNION SELECT p, p - 6 FROM p WHERE k = 7 AND f % 2 = 0 UNION SELECT p, p - 1 FROM p WHERE k = 8 AND f % 2 = 0 UNION SELECT p, p + 5 FROM p WHERE k = 0 AND f % 3 = 0)"""
_LOOPS = f"""{_BLOCKS}, r(avoid, node) AS (SELECT a.p, b.p FROM p a JOIN p b ON a.f = b.f AND b.k = 0 AND a.p <> b.p UNION SELECT avoid, dst FROM r JOIN e ON r.node = e.src WHERE dst <> avoid),
w(node) AS (SELECT p FROM p WHERE k = 0 UNION SELECT dst FROM w JOIN e ON w.node = e.src), s AS MATERIALIZED (SELECT src, dst FROM e WHERE src IN (SELECT node FROM w)),
b(header, node) AS (SELECT dst, src FROM s WHERE (dst, src) NOT IN (SELECT (avoid, node) FROM r) UNION SELECT b.header, s.src FROM b JOIN s ON s.dst = b.node WHERE b.node <> b.header),
m AS MATERIALIZED (SELECT header, node FROM b UNION SELECT header, header FROM b)"""


def _blocks(t):
    k, p, f = F.col("p_partkey") % 10, F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    jump = lambda when, by: t.part.where(when).select(p.alias("src"), (p + by).alias("dst"))
    even = f % 2 == 0
    return jump(k < 9, 1).union(jump((k == 4) & even, -2)).union(jump((k == 7) & even, -6)).union(jump((k == 8) & even, -1)).union(jump((k == 0) & (f % 3 == 0), 5)).distinct()


def _entered(t):
    entries = t.part.where("p_partkey % 10 = 0").select(F.lit(-1).cast("long").alias("src"), F.col("p_partkey").alias("dst"))
    return _blocks(t).union(entries)


@query(f"{_LOOPS} SELECT header, node FROM m")
def loop_members(t):
    return flow.natural_loops(_entered(t), -1)[0]


@query(f"""{_LOOPS}, d AS (SELECT x.node AS header, count(*) AS depth FROM m x WHERE x.node IN (SELECT header FROM m) GROUP BY 1)
SELECT header, (SELECT arg_max(o.header, d.depth) FROM m o JOIN d ON d.header = o.header WHERE o.node = m.header AND o.header <> m.header) AS parent, any_value(d.depth) AS depth, count(*) AS size FROM m JOIN d USING (header) GROUP BY header""")
def natural_loops(t):
    """Loops of all functions with what they are nested in; cycles with two entries are none."""
    return flow.natural_loops(_entered(t), -1)[1]


@query(f"""{_BLOCKS}, i AS (SELECT unnest([0, 1]) AS item), start AS (SELECT p AS block, item FROM p, i WHERE k = 0), w(node) AS (SELECT block FROM start UNION SELECT dst FROM w JOIN e ON w.node = e.src),
gain AS (SELECT p AS block, item FROM p, i WHERE (k = 1 AND item = 0) OR (k = 5 AND item = 1)), lose AS (SELECT p AS block, item FROM p, i WHERE (k = 8 AND item = 0) OR (k = 6 AND item = 1 AND f % 5 = 0)),
u(block, item) AS (SELECT block, item FROM start UNION SELECT dst, item FROM lose JOIN e ON block = src WHERE block IN (SELECT node FROM w) UNION SELECT e.dst, u.item FROM u JOIN e ON u.block = e.src WHERE (u.block, u.item) NOT IN (SELECT (block, item) FROM gain))
SELECT p AS block, item, (p, item) NOT IN (SELECT (block, item) FROM u) AS is_guarded FROM p, i WHERE p IN (SELECT node FROM w)""")
def guarded_accesses(t):
    """Which of two locks all ways to a block hold: one is taken early and given back late, the other is given back by some functions."""
    k, f = F.col("p_partkey") % 10, F.floor(F.col("p_partkey") / 10)
    at = lambda when, item: t.part.where(when).select(F.col("p_partkey").alias("block"), F.lit(item).alias("item"))
    both = lambda when: at(when, 0).union(at(when, 1))
    gains, loses = at(k == 1, 0).union(at(k == 5, 1)), at(k == 8, 0).union(at((k == 6) & (f % 5 == 0), 1))
    return flow.guarded(_blocks(t), both(k == 0), gains, loses, both(F.lit(True))).select("block", "item", "is_guarded")


_KIND = "CASE event_id % 5 WHEN 0 THEN 'enter' WHEN 1 THEN 'enter' WHEN 2 THEN 'leave' WHEN 3 THEN 'leave' ELSE 'none' END"


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r(user_id, i, event_id, kind, stack) AS (SELECT user_id, i, event_id, kind, []::BIGINT[] FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, s.event_id, s.kind, CASE r.kind WHEN 'enter' THEN list_append(r.stack, r.event_id) WHEN 'leave' THEN r.stack[:-2] ELSE r.stack END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT event_id, len(stack)::BIGINT AS depth, array_to_string(stack, '/') AS stack FROM r""")
def include_stack(t):
    """What is open at each event of a user: a stack, as of files that include files."""
    kind = F.expr(_KIND)
    found = scan.open_regions(t.events.select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")
    return found.select("event_id", "depth", F.array_join(F.transform("stack", lambda x: x.cast("string")), "/").alias("stack"))
