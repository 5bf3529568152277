"""Facts that follow from facts, until nothing new follows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.session import discard, materialize


#: A round of at most so many rows, and at most a tenth of those that are known, goes to every task: what it meets isn't shuffled.
BROADCAST_ROWS = 100_000


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame], hops: int = 2, tag: str = "facts", few: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All rows of start and what step makes of rows, again and again. step keeps the columns and treats each row by itself (a join, not an aggregate).

    Only rows that weren't there go on, so it ends wherever there are finitely many different ones; a round goes
    so many hops ahead, and each is written to the shared folder, so the plan doesn't grow. A round of few rows goes
    one hop ahead by broadcasts; few: step for these, where marking its rows for a broadcast isn't enough.
    """
    seen = [materialize(start.distinct(), tag)]
    names = start.columns
    count = seen[0].count()
    total = count
    while True:
        known = reduce(DataFrame.unionByName, seen).select(*[F.col(c).alias(f"__{c}") for c in names])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
        if count <= BROADCAST_ROWS and total >= 10 * count:
            found = materialize((few or step)(F.broadcast(seen[-1])).distinct(), f"{tag}-next")
            if found.count() <= BROADCAST_ROWS:
                known = known.join(F.broadcast(found), same, "left_semi")
            fresh = materialize(found.join(known, same, "left_anti"), tag)
            discard(found)
        else:
            ahead, made = seen[-1], []
            for _ in range(hops):
                ahead = step(ahead)
                made.append(ahead)
            fresh = materialize(reduce(DataFrame.unionByName, made).distinct().join(known, same, "left_anti"), tag)
        count = fresh.count()
        if not count:
            discard(fresh)
            return reduce(DataFrame.unionByName, seen)
        total += count
        seen.append(fresh)


def follow(links: DataFrame, keys: list[str]) -> DataFrame:
    """links (keys, a, b; a distinct within keys) -> keys, a, end, steps: where following from a leads, and how far; end is NULL where it goes in circles.

    Each round goes twice as far. As long as runs are left, some end in each round; once none does, what is left
    goes in circles.
    """
    # Nodes that lead on are rows; where none starts, a way ends.
    at, left = materialize(links.select(*keys, "a", F.col("b").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moving")), "follow"), -1
    while True:
        ahead = at.select(*keys, F.col("a").alias("end"), F.col("end").alias("__end"), F.col("steps").alias("__steps"))
        joined = at.where("moving").join(ahead, [*keys, "end"], "left")
        step = joined.select(*keys, "a", F.coalesce("__end", "end").alias("end"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__end").isNotNull().alias("moving"))
        fresh = materialize(step.unionByName(at.where("NOT moving")), "follow")
        discard(at)
        at = fresh
        moving = at.where("moving").count()
        if not moving:
            return at.select(*keys, "a", "end", "steps")
        if moving == left:
            return at.select(*keys, "a", F.when(~F.col("moving"), F.col("end")).alias("end"), "steps")
        left = moving


def ring_nodes(links: DataFrame) -> DataFrame:
    """links (a, b; a distinct) that all lead round -> node: those on the rings, without those that only lead to one.

    Ends of ways of n steps are the rings' nodes and those with a way of n steps to them. As long as there are any of
    these, ways twice as long end in fewer nodes.
    """
    at = materialize(links.select("a", "b"), "ringed")
    n = at.select("b").distinct().count()
    while True:
        step = materialize(at.join(at.select(F.col("a").alias("b"), F.col("b").alias("__b")), "b").select("a", F.col("__b").alias("b")), "ringed")
        discard(at)
        at, before, n = step, n, step.select("b").distinct().count()
        if n == before:
            return at.select(F.col("b").alias("node")).distinct()


def mark_back(links: DataFrame, marked: DataFrame) -> DataFrame:
    """links (a, b; a distinct, none leads round), marked (node) -> node: nodes of a that a marked one leads to, or that are marked; in rounds that double."""
    marked = marked.distinct().select(F.col("node").alias("a"), F.lit(True).alias("__on"))
    at = materialize(links.join(marked, "a", "left").select("a", "b", F.col("__on").isNotNull().alias("on")), "marks")
    while not at.where("b IS NOT NULL").isEmpty():
        sent = at.where("on AND b IS NOT NULL").select(F.col("b").alias("a"), F.lit(True).alias("__on")).distinct()
        ahead = at.select(F.col("a").alias("b"), F.col("b").alias("__b"))
        step = at.join(sent, "a", "left").join(ahead, "b", "left").select("a", F.col("__b").alias("b"), (F.col("on") | F.col("__on").isNotNull()).alias("on"))
        step = materialize(step, "marks")
        discard(at)
        at = step
    return at.where("on").select(F.col("a").alias("node"))


def least_of_rings(links: DataFrame) -> DataFrame:
    """links (a, b) that are rings only -> node, least: the least node of each one's ring, in rounds that double."""
    at, changed = materialize(links.select("a", F.col("b").alias("end"), F.least("a", "b").alias("least")), "rings"), True
    while changed:
        ahead = at.select(F.col("a").alias("end"), F.col("end").alias("__end"), F.col("least").alias("__least"))
        step = at.join(ahead, "end").select("a", F.col("__end").alias("end"), F.least("least", "__least").alias("least"), (F.col("__least") < F.col("least")).alias("fell"))
        step = materialize(step, "rings")
        discard(at)
        at, changed = step, not step.where("fell").isEmpty()
    return at.select(F.col("a").alias("node"), "least")


def trail(links: DataFrame, starts: DataFrame) -> DataFrame:
    """links (a, b; a distinct), starts (node) -> node, steps: what lies on the ways from the starts, at its least distance from one.

    Each round's hops are twice as long, and what was met so far makes one hop, so a way of n steps takes log n
    rounds. It ends when a round meets nothing new, in circles too. Joins ask for sorted ranges: hops are small as files only.
    """
    hops = materialize(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "trail")
    met, length = materialize(starts.select("node").distinct().withColumn("steps", F.lit(0).cast("long")), "trail"), 1
    while True:
        ahead = met.join(hops.hint("merge"), F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg((F.min("steps") + length).alias("steps"))
        fresh = materialize(ahead.join(met.select("node").hint("merge"), "node", "left_anti").select("node", "steps"), "trail")
        if fresh.isEmpty():
            discard(fresh)
            discard(hops)
            return met
        both = materialize(met.unionByName(fresh), "trail")
        longer = materialize(hops.join(hops.select(F.col("a").alias("b"), F.col("b").alias("__next")).hint("merge"), "b").select("a", F.col("__next").alias("b")), "trail")
        for used in (met, fresh, hops):
            discard(used)
        met, hops, length = both, longer, length * 2
