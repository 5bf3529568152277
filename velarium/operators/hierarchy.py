"""Hierarchies and graphs: closures, roll-ups, cycles, reachability, lineage roots."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.operators.components import roots  # noqa: F401  part of this module's functions
from velarium.operators.ranking import places
from velarium.session import discard, materialize

_names = itertools.count()
#: Ways of at most so many steps together go to every task.
BROADCAST_STEPS = 100_000


def levels_closure(parents: DataFrame, levels: int) -> DataFrame:
    """parents (node, parent) of a hierarchy with so many levels -> ancestor, node, depth; each node is its own at depth 0.

    One join for each level, all by node; nothing is collected and nothing iterates over data.
    """
    at = parents.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    out = [at]
    up = parents.where("parent IS NOT NULL").select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
    for depth in range(1, levels):
        at = at.join(up, F.col("ancestor") == F.col("__n")).select(F.col("__p").alias("ancestor"), "node", F.lit(depth).alias("depth"))
        out.append(at)
    return reduce(DataFrame.unionByName, out)


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """edges (a, b), start (node) -> start, node, depth, path, cycle: all ways of at most so many steps that repeat no node, but for the step that closes a cycle."""
    spark, n = edges.sparkSession, next(_names)
    edges.createOrReplaceTempView(f"__edges{n}")
    start.createOrReplaceTempView(f"__start{n}")
    return spark.sql(f"""
        WITH RECURSIVE w(start, node, depth, path, cycle) AS (
            SELECT node, node, 0, array(node), false FROM __start{n}
            UNION ALL
            SELECT w.start, e.b, w.depth + 1, concat(w.path, array(e.b)), array_contains(w.path, e.b)
            FROM w JOIN __edges{n} e ON e.a = w.node WHERE NOT w.cycle AND w.depth < {int(depth)}
        ) SELECT * FROM w""")


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth: what can be reached, at its least depth.

    Nodes are reduced at each step, so the ways to them don't multiply, and each step is written to the
    shared folder, so the plan doesn't grow with the depth. Ends early when nothing new is found.
    """
    seen = front = materialize(start.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = materialize(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth")), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def on_cycle(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node: the nodes of cycles of any length, where each node has one edge out at most (as of parents).

    Each node's pointer goes twice as far at each round. Where a way leads nowhere the pointer goes; what pointers
    lead to shrinks to the cycles, and is these once a round takes nothing more away.
    """
    at, before = materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "cycle"), -1
    while True:
        ends = at.agg(F.count_distinct("b")).first()[0]
        if ends == before:
            return at.select(F.col("b").alias("node")).distinct()
        before = ends
        at = materialize(at.join(at.select(F.col("a").alias("__x"), F.col("b").alias("__next")), F.col("b") == F.col("__x")).select("a", F.col("__next").alias("b")), "cycle")


def tree(nodes: DataFrame) -> DataFrame:
    """nodes (node, parent, position, name; node unique) -> node, depth (of a root 0), path (names by /), place (from 1, parents before children, siblings by position, name, node).

    A node without a known parent is a root. What lies on a circle or below one hangs on no root and has no row. Each round
    joins the ways found so far to each other, so a tree of depth n takes log n rounds, and the places come from ranges.
    Rows that hang on a root are left out of the joins. Where the others hang on few nodes, as in late rounds, these nodes go to
    every task; else joins ask for sorted ranges, as ways are small as files, where names repeat, and large in memory.
    """
    own = F.struct("position", F.coalesce("name", F.lit("")).alias("name"), "node")
    known = nodes.select(F.col("node").alias("__node"))
    at = nodes.join(known.hint("merge"), F.col("parent") == F.col("__node"), "left").select("node", F.col("__node").alias("up"), F.array(own).alias("way"))
    at, left = materialize(at, "tree"), -1
    while True:
        open_ = at.where("up IS NOT NULL").count()
        if open_ in (0, left):
            # With as many as before, none of what is left leads to a root.
            rooted = at.where("up IS NULL").select("node", "way")
            return places(rooted, ["way"]).select("node", (F.size("way") - 1).alias("depth"), F.array_join("way.name", "/").alias("path"), "place")
        left = open_
        above = at.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("way").alias("__way"))
        ups = at.where("up IS NOT NULL").select("up").distinct()
        few = ups.count() <= BROADCAST_STEPS
        if few:
            above = above.join(F.broadcast(ups), "up", "left_semi")
            few = above.agg(F.coalesce(F.sum(F.size("__way")), F.lit(0))).first()[0] <= BROADCAST_STEPS
        joined = at.where("up IS NOT NULL").join(F.broadcast(above) if few else above.hint("merge"), "up").select("node", F.col("__up").alias("up"), F.concat("__way", "way").alias("way"))
        fresh = materialize(joined.unionByName(at.where("up IS NULL")), "tree")
        discard(at)
        at = fresh
