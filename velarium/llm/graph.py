"""Connected components of a link table, without gathering any component in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize

#: A round halves the longest chain about; this many rounds suffice for any table that fits on disks.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to its least one. Small star: its smaller neighbours and itself."""
    if large:
        near = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(linked.select("u", "m"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> node, root: each node that has a link, and the least node it can reach.

    Alternates large and small stars until the links stand still; each round is two joins and is
    written to the shared folder. Hubs are joins with a frequent key, which Spark splits at run time.
    """
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = materialize(_star(_star(edges, True), False), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent: for each node a node no larger of its class, roots their own. Joins the classes of a[i] and b[i]; all then point to their root."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
