"""Hierarchies, graphs and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.operators import components as C
from velarium.operators import hierarchy as H
from velarium.registry import query
from velarium.session import materialize, table

_TREE = "SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"
_CLOSURE = f"t AS ({_TREE}), w(ancestor, node, depth) AS (SELECT node, node, 0 FROM t UNION ALL SELECT t.parent, w.node, w.depth + 1 FROM w JOIN t ON t.node = w.ancestor WHERE t.parent IS NOT NULL)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one table of members and parents."""
    code = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    region = table(spark, sf_dir, "region").select(code("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf_dir, "nation").select(code("n", "n_nationkey").alias("node"), code("r", "n_regionkey").alias("parent"))
    return region.unionByName(nation).unionByName(table(spark, sf_dir, "customer").select(code("c", "c_custkey").alias("node"), code("n", "c_nationkey").alias("parent")))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT ancestor, node, depth FROM w")
def hier_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.levels_closure(tree(spark, sf_dir), 3)


@query(f"WITH RECURSIVE {_CLOSURE} SELECT ancestor, count(*) - 1 AS n_below FROM w GROUP BY 1")
def hier_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.levels_closure(tree(spark, sf_dir), 3).groupBy("ancestor").agg((F.count(F.lit(1)) - 1).alias("n_below"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT ancestor, round(sum(o_totalprice), 2) AS amount FROM w JOIN customer ON node = 'c' || c_custkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def hier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure at every member: added up by leaf before it meets the closure."""
    leaves = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")).agg(F.sum("o_totalprice").alias("amount"))
    return H.levels_closure(tree(spark, sf_dir), 3).join(leaves, "node").groupBy("ancestor").agg(F.round(F.sum("amount"), 2).alias("amount"))


@query("SELECT 'c' || c_custkey AS node, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hier_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


@query("SELECT l_linenumber AS level, row_number() OVER (ORDER BY l_linenumber) AS depth, lag(l_linenumber) OVER (ORDER BY l_linenumber) AS parent FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def hier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered levels: depth from 1, the level before as parent. Levels are few."""
    w = W.orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select(F.col("l_linenumber").alias("level"), F.row_number().over(w).cast("long").alias("depth"), F.lag("l_linenumber").over(w).alias("parent"))


_EDGES = "SELECT s_suppkey AS a, s_suppkey * 2 % 97 AS b FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 10 FROM supplier WHERE s_suppkey % 10 = 3"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 2 % 97).alias("b")).union(supplier.where("s_suppkey % 10 = 3").select("s_suppkey", F.col("s_suppkey") + 10))


@query(f"WITH RECURSIVE e AS ({_EDGES}), w(node, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 6) SELECT node, min(depth) AS depth FROM w GROUP BY 1")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth first, within six steps."""
    return H.reach(edges(spark, sf_dir), spark.range(5, 6).select(F.col("id").alias("node")), 6)


@query(f"WITH e AS ({_EDGES}) SELECT node, count(DISTINCT other) AS n FROM (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY 1")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a")).groupBy("node").agg(F.count_distinct("other").alias("n"))


_RING = "SELECT s_suppkey AS a, CASE WHEN s_suppkey % 6 = 5 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS b FROM supplier WHERE s_suppkey % 6 <> 0"


@query(f"WITH RECURSIVE e AS ({_RING}), w(start, node, depth) AS (SELECT a, a, 0 FROM e UNION ALL SELECT w.start, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 8 AND (w.depth = 0 OR w.node <> w.start)) SELECT DISTINCT start AS node FROM w WHERE depth > 0 AND node = start")
def hier_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members on a cycle of parents."""
    e = table(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("a"), F.when(F.col("s_suppkey") % 6 == 5, F.col("s_suppkey") - 4).otherwise(F.col("s_suppkey") + 1).alias("b"))
    return H.on_cycle(e)


_UP = "SELECT s_suppkey AS node, s_suppkey // 2 AS source FROM supplier WHERE s_suppkey >= 2 AND s_suppkey % 7 <> 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey >= 3 AND s_suppkey % 7 <> 0"


def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0")
    half = lambda n: s.where(f"s_suppkey >= {n}").select(F.col("s_suppkey").alias("node"), F.expr(f"s_suppkey div {n}").alias("source"))
    return half(2).union(half(3)).distinct()


@query(f"WITH RECURSIVE u AS ({_UP}), w(node, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT w.node, u.source FROM w JOIN u ON u.node = w.root) SELECT node, root FROM w WHERE root NOT IN (SELECT node FROM u)")
def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.roots(upstream(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"WITH RECURSIVE u AS ({_UP}), w(node, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT w.node, u.source FROM w JOIN u ON u.node = w.root) SELECT node, count(DISTINCT root) AS n_roots FROM w WHERE root NOT IN (SELECT node FROM u) GROUP BY 1")
def lineage_root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent sources of each node."""
    return lineage_roots(spark, sf_dir).groupBy("node").agg(F.count_distinct("root").alias("n_roots"))


@query(f"SELECT node, source FROM ({_UP}) WHERE source NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 <> 0)")
def lineage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that aren't among the known ones."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").select(F.col("s_suppkey").alias("source"))
    return upstream(spark, sf_dir).join(known, "source", "left_anti").select("node", "source")


_MUTUAL = f"e AS ({_EDGES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), c AS (SELECT node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = node), node) AS component FROM n)"


def named_components(edges_: DataFrame) -> DataFrame:
    """Strong components, named by their least node."""
    found = materialize(C.strong_components(edges_), "components")
    return found.join(found.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))


@query(f"WITH RECURSIVE {_MUTUAL} SELECT node, component FROM c")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lead to each other."""
    return named_components(edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_MUTUAL} SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN c x ON x.node = e.a JOIN c y ON y.node = e.b WHERE x.component <> y.component")
def graph_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the components, which has no cycle."""
    rows = edges(spark, sf_dir)
    return C.condense(rows, named_components(rows))


_FRAGMENTS = "SELECT s_suppkey AS key FROM supplier WHERE s_suppkey % 19 <> 11 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 23 = 5"
_INCLUDES = (
    "SELECT s_suppkey AS key, 0 AS position, CASE WHEN s_suppkey % 8 < 6 THEN s_suppkey // 2 ELSE s_suppkey * 2 % 97 END AS target, CASE WHEN s_suppkey % 29 = 7 THEN 'REFERENCE' END AS dynamic FROM supplier WHERE s_suppkey % 3 <> 0"
    " UNION ALL SELECT s_suppkey, 1, s_suppkey + 10, CASE WHEN s_suppkey % 4 = 1 THEN 'PROPERTY' END FROM supplier WHERE s_suppkey % 10 = 3"
)


@query(f"""
    WITH RECURSIVE f AS ({_FRAGMENTS}), i AS ({_INCLUDES}), k AS (SELECT key, count(*) AS n FROM f GROUP BY 1), l AS (SELECT i.* FROM i JOIN k USING (key) WHERE n = 1),
    e AS (SELECT key AS a, target AS b FROM l WHERE dynamic IS NULL), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    fault AS (SELECT key, CASE WHEN max(n) IS NULL THEN 'UNRESOLVED' ELSE 'AMBIGUOUS' END AS status FROM (SELECT key FROM f UNION SELECT target FROM i UNION SELECT s_suppkey FROM supplier) LEFT JOIN k USING (key) GROUP BY 1 HAVING coalesce(max(n), 0) <> 1),
    seed AS (SELECT key FROM fault UNION SELECT key FROM l WHERE dynamic IS NOT NULL UNION SELECT a FROM r WHERE a = b),
    bad AS (SELECT key FROM seed UNION SELECT a FROM r JOIN seed ON key = b),
    nxt AS (SELECT key, min_by(target, position) AS target, min_by(coalesce(dynamic, ''), position) AS dynamic FROM l WHERE dynamic IS NOT NULL OR target IN (SELECT key FROM bad) GROUP BY 1),
    stops AS (SELECT key, 'DYNAMIC_' || dynamic AS status FROM nxt WHERE dynamic <> '' UNION ALL SELECT key, status FROM fault),
    w(start, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT w.start, n.target FROM w JOIN nxt n ON n.key = w.node AND n.dynamic = '')
    SELECT s_suppkey AS key, coalesce((SELECT min(status) FROM w JOIN stops ON stops.key = w.node WHERE w.start = s_suppkey), CASE WHEN s_suppkey IN (SELECT key FROM bad) THEN 'CYCLE' ELSE 'RESOLVED' END) AS status FROM supplier
""")
def include_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each fragment's includes resolve, passed on along includes."""
    supplier = table(spark, sf_dir, "supplier")
    fragments = supplier.where("s_suppkey % 19 <> 11").select("s_suppkey").unionAll(supplier.where("s_suppkey % 23 = 5").select("s_suppkey")).withColumnRenamed("s_suppkey", "key")
    first = supplier.where("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS key", "0 AS position", "CASE WHEN s_suppkey % 8 < 6 THEN s_suppkey div 2 ELSE s_suppkey * 2 % 97 END AS target", "CASE WHEN s_suppkey % 29 = 7 THEN 'REFERENCE' END AS dynamic")
    second = supplier.where("s_suppkey % 10 = 3").selectExpr("s_suppkey AS key", "1 AS position", "s_suppkey + 10 AS target", "CASE WHEN s_suppkey % 4 = 1 THEN 'PROPERTY' END AS dynamic")
    return C.resolve_includes(fragments, first.unionByName(second), supplier.select(F.col("s_suppkey").alias("key")))


_NODES = "SELECT c_custkey AS node, CASE WHEN c_custkey % 97 = 13 THEN c_custkey * 2 WHEN c_custkey % 31 = 5 THEN -1 WHEN c_custkey > 0 THEN c_custkey {d} 2 END AS parent, c_custkey * 7 % 3 AS position, concat('m', c_custkey * 13 % 40) AS name FROM customer"


@query(f"""WITH RECURSIVE v AS ({_NODES.format(d='//')}), w(node, depth, path, way) AS (SELECT node, 0, name, [{{'p': position, 'n': name, 'k': node}}] FROM v WHERE parent IS NULL OR parent NOT IN (SELECT node FROM v)
    UNION ALL SELECT v.node, depth + 1, path || '/' || name, list_append(way, {{'p': position, 'n': name, 'k': v.node}}) FROM w JOIN v ON v.parent = w.node) SELECT node, depth, path, row_number() OVER (ORDER BY way) AS place FROM w""")
def hier_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a tree of any depth with their paths, in the tree's order; some have an unknown parent, some are on circles."""
    return H.tree(spark.sql(_NODES.format(d="div").replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")))
