"""Strongly connected components, condensed graphs, roots through them, and how references resolve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.operators.fixpoint import closure, follow, least_of_rings, mark_back, ring_nodes
from velarium.session import discard, materialize


def _spread(edges: DataFrame, labels: DataFrame, tag: str = "colours") -> DataFrame:
    """edges (a, b), labels (node, label) -> node, label: the greatest label that leads to each node, its own among them."""
    at = materialize(labels.withColumn("fresh", F.lit(True)), tag)
    while True:
        sent = at.where("fresh").join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "label")
        more = sent.groupBy("node").agg(F.max("label").alias("__sent"))
        step = at.join(more, "node", "left").select("node", F.greatest("label", "__sent").alias("label"), F.coalesce(F.col("__sent") > F.col("label"), F.lit(False)).alias("fresh"))
        step = materialize(step, tag)
        discard(at)
        at = step
        if at.where("fresh").isEmpty():
            return at.select("node", "label")


def _trim(edges: DataFrame) -> DataFrame:
    """edges without those that lead from nodes that nothing leads to, or to nodes that lead nowhere, again and again: what is left holds all cycles."""
    left = -1
    at = edges
    while True:
        n = at.count()
        if n in (left, 0):
            return at
        left = n
        inside = at.select(F.col("b").alias("a")).intersect(at.select("a"))
        step = materialize(at.join(inside, "a", "left_semi").select("a", "b").join(inside.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "trimmed")
        if at is not edges:
            discard(at)
        at = step


def _shrink(at: DataFrame) -> tuple[DataFrame, tuple | None]:
    """edges (a, b; a isn't b) -> edges without nodes that one node alone leads to, and what _grow needs to put them back.

    A way to such a node passes the one before it, so all ways to it pass its root, the first node back that isn't such a one.
    Its ways on become its root's, which leaves the components of all others as they are. Where going back leads round, the
    ring is a component, and what hangs from it is alone.
    """
    stems = materialize(at.groupBy(F.col("b").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("b")).where("n = 1").select("a", "b"), "stems")
    if stems.isEmpty():
        return at, None
    ends = materialize(follow(stems, []).select("a", "end"), "ends")
    turning = ends.where("end IS NULL").select("a")
    rooted = ends.where("end IS NOT NULL").select(F.col("a").alias("node"), F.col("end").alias("root"))
    rings = None
    if not turning.isEmpty():
        circling = stems.join(turning, "a", "left_semi")
        rings = least_of_rings(circling.join(ring_nodes(circling).withColumnRenamed("node", "a"), "a", "left_semi")).withColumnRenamed("least", "component")
    ways = at.join(turning, "a", "left_anti").join(stems.select(F.col("a").alias("b")), "b", "left_anti")
    ways = materialize(ways.join(rooted.select(F.col("node").alias("a"), "root"), "a", "left").select("a", F.coalesce("root", "a").alias("root"), "b"), "ways")
    return materialize(ways.where("root <> b").select(F.col("root").alias("a"), "b").distinct(), "shrunk"), (stems.join(turning, "a", "left_anti"), rooted, rings, ways)


def _grow(level: tuple, known: DataFrame) -> DataFrame:
    """known (node, component: of nodes that aren't alone) of the edges that _shrink gave -> known of those that it took.

    A node taken away is in its root's component if a node from it on, in the tree below its root, leads back to that component; else it is alone.
    """
    stems, rooted, rings, ways = level
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))
    back = ways.where("a <> root").join(of("root"), "root", "left").join(of("b"), "b", "left").where("coalesce(__root, root) = coalesce(__b, b)")
    inside = mark_back(stems, back.select(F.col("a").alias("node"))).join(rooted, "node").join(of("root"), "root", "left")
    more = known.unionByName(inside.select("node", F.coalesce("__root", "root").alias("component")))
    return materialize(more.unionByName(rings) if rings is not None else more, "known")


def strong_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component: a node for each node of an edge; nodes that lead to each other share a component, named by one of them.

    Nodes that one node alone leads to are merged into it, however long the runs and trees of them, in rounds that double;
    then those that lead to one node alone, and so on while the graph gets smaller by a fifth. The rest by
    forward-backward colouring: nodes that can't be on a cycle are trimmed away; each other node takes the greatest node
    that leads to it as its colour; of a colour, what leads back to that node is a component. Edges of components found
    are taken away, and the rest is coloured again. All steps are joins and aggregates.
    """
    whole = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "edges")
    nodes = whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct()
    at, levels = whole.where("a <> b"), []
    n = at.count()
    while n:
        inside = at.select(F.col("b").alias("a")).intersect(at.select("a"))
        at = materialize(at.join(inside, "a", "left_semi").join(inside.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "inside")
        for _ in range(2):  # forwards, then backwards
            at, level = _shrink(at)
            levels += [level] if level else []
            at = at.select(F.col("b").alias("a"), F.col("a").alias("b"))
        before, n = n, at.count()
        if n > before * 0.8:
            break
    known = nodes.select("node", F.col("node").alias("component")).limit(0)
    if n:
        found = _coloured(materialize(at, "core"))
        several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        known = materialize(found.join(several, "component", "left_semi").select("node", "component"), "known")
    for level in reversed(levels):
        known = _grow(level, known)
    return nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _coloured(whole: DataFrame) -> DataFrame:
    """Components of a graph, by colours: node, component, a row for each node of an edge."""
    nodes = whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct()
    left, found = _trim(whole), []
    while not left.isEmpty():
        colours = _spread(left, left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node")))
        of = lambda c: colours.select(F.col("node").alias(c), F.col("label").alias(f"__{c}"))
        same = materialize(left.join(of("a"), "a").join(of("b"), "b").where("__a = __b").select("a", "b", F.col("__a").alias("label")), "coloured")
        heads = colours.where("node = label").select("node", "label")
        back = closure(heads, lambda rows, same=same: rows.join(same.withColumnRenamed("label", "__l"), (F.col("node") == F.col("b")) & (F.col("label") == F.col("__l"))).select(F.col("a").alias("node"), "label"), tag="component")
        done = materialize(back, "component")
        found.append(done)
        gone = done.select(F.col("node").alias("a"))
        left = _trim(materialize(left.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "left"))
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    return materialize(nodes.join(reduce(DataFrame.unionByName, found), "node", "left").select("node", F.coalesce("label", "node").alias("component")), "components")


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """edges (a, b) between components: distinct, without those inside one. The result has no cycle."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))
    return edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("__a <> __b").select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct()


def on_cycle(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node: those on a cycle, of any length."""
    components = materialize(strong_components(edges), "components")
    several = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    own = edges.where("a = b").select(F.col("a").alias("node"))
    return components.join(several, "component", "left_semi").select("node").union(own).distinct()


def roots(upstream: DataFrame, nodes: DataFrame) -> DataFrame:
    """upstream (node, source) -> node, root: the sources without a source of their own that each of nodes goes back to, however far; ways into a cycle have none.

    A run of nodes with one source each is skipped to its end (rounds that double); roots are then handed down from
    the top, a level a round, so that there are only as many pairs as answers, however many ways lead to a root.
    """
    up = materialize(upstream.select(F.col("node").alias("a"), F.col("source").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "upstream")
    single = up.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    ahead = materialize(follow(single, []).select("a", "end"), "ahead")  # NULL: round and round
    skip = ahead.select(F.col("a").alias("b"), F.col("end").alias("__end"), F.lit(True).alias("__skips"))
    many = up.join(single.select("a"), "a", "left_anti").join(skip, "b", "left")
    short = materialize(many.select("a", F.when(F.col("__skips"), F.col("__end")).otherwise(F.col("b")).alias("b")).where("b IS NOT NULL").distinct(), "upstream")
    tops = materialize(short.select("b").union(ahead.select(F.col("end").alias("b"))).union(nodes.select("node")).where("b IS NOT NULL").distinct().join(up.select(F.col("a").alias("b")), "b", "left_anti"), "tops")
    down = short.select("a", F.col("b").alias("__b"))
    pairs = materialize(closure(tops.select(F.col("b").alias("node"), F.col("b").alias("root")), lambda rows: rows.join(down, F.col("node") == F.col("__b")).select(F.col("a").alias("node"), "root"), tag="roots"), "roots")
    at = nodes.select("node").distinct().join(ahead.select(F.col("a").alias("node"), "end", F.lit(True).alias("__skips")), "node", "left")
    at = at.select(F.col("node").alias("__node"), F.when(F.col("__skips"), F.col("end")).otherwise(F.col("node")).alias("node"))
    return at.join(pairs, "node").select(F.col("__node").alias("node"), "root")


def resolve_includes(fragments: DataFrame, includes: DataFrame, asked: DataFrame) -> DataFrame:
    """fragments (key: a row for each definition), includes (key, position, target, dynamic: NULL, PROPERTY or REFERENCE), asked (key) -> key, status.

    A key that nothing defines is UNRESOLVED, one with several definitions AMBIGUOUS. Else its includes are taken in
    their order, and the first that isn't static gives its own status: DYNAMIC_PROPERTY or DYNAMIC_REFERENCE, or its
    target's, or CYCLE where following leads round. With none, it is RESOLVED.

    Keys that can lead to a fault are those from which a fault or a cycle can be reached; of each, the first
    include that does so is its one way on, so that each status is at the end of a run of single ways.
    """
    keys = fragments.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(asked.select("key").union(fragments.select("key")).union(includes.where("dynamic IS NULL").select(F.col("target").alias("key"))).distinct().join(keys, "key", "left"), "keys")
    sound = known.where("n = 1").select("key")
    lines = materialize(includes.join(sound, "key", "left_semi").select("key", "position", "target", "dynamic"), "includes")
    faults = known.where("n IS NULL OR n <> 1").select("key", F.when(F.col("n").isNull(), "UNRESOLVED").otherwise("AMBIGUOUS").alias("status"))
    ways = lines.where("dynamic IS NULL").select(F.col("key").alias("a"), F.col("target").alias("b"))
    start = faults.select("key").union(lines.where("dynamic IS NOT NULL").select("key")).union(on_cycle(ways).select(F.col("node").alias("key")))
    bad = materialize(closure(start, lambda rows: rows.join(ways, F.col("key") == F.col("b")).select(F.col("a").alias("key")), tag="faulty"), "faulty")
    telling = lines.join(bad.select(F.col("key").alias("target"), F.lit(True).alias("__bad")), "target", "left").where("dynamic IS NOT NULL OR __bad")
    first = materialize(telling.groupBy("key").agg(F.min_by(F.struct("target", "dynamic"), "position").alias("w")).select("key", "w.*"), "first")
    stops = first.where("dynamic IS NOT NULL").select("key", F.concat(F.lit("DYNAMIC_"), "dynamic").alias("status")).unionByName(faults)
    ends = follow(first.where("dynamic IS NULL").select(F.col("key").alias("a"), F.col("target").alias("b")), []).select(F.col("a").alias("key"), "end", F.lit(True).alias("__on"))
    at = asked.select("key").distinct().join(ends, "key", "left").select("key", F.when(F.col("__on"), F.col("end")).otherwise(F.col("key")).alias("__end"))
    out = at.join(stops.select(F.col("key").alias("__end"), "status"), "__end", "left")
    return out.select("key", F.when(F.col("__end").isNull(), "CYCLE").otherwise(F.coalesce("status", F.lit("RESOLVED"))).alias("status"))
