"""Joins: equi, semi, anti, outer, interval, theta, as-of, division and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import joins as J
from velarium.registry import query
from velarium.session import table


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice > 300000").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The many side is aggregated before the join, so rows can't multiply."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS shipped FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT o.l_linenumber, count(*) AS n_lines, count(shipped) AS n_shipped FROM o LEFT JOIN s USING (l_orderkey, l_linenumber) GROUP BY 1")
def join_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    shipped = lines.where("l_linestatus = 'F'").groupBy(*keys).agg(F.sum("l_quantity").alias("shipped"))
    return lines.select(*keys).distinct().join(shipped, keys, "left").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_lines"), F.count("shipped").alias("n_shipped"))


@query("SELECT a.n_name AS nation, count(b.n_name) AS neighbours FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1")
def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others share a nation's region; counted, not paired."""
    nation = table(spark, sf_dir, "nation")
    sizes = nation.groupBy("n_regionkey").agg((F.count(F.lit(1)) - 1).alias("neighbours"))
    return nation.join(sizes, "n_regionkey").select(F.col("n_name").alias("nation"), "neighbours")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 350000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 430000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 430000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


_VERSIONS = "base AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 7 <> 0), nxt AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 11 <> 0)"


def part_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a catalog: some parts removed, some added, some changed."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    changed = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return part.where("p_partkey % 7 <> 0"), changed


@query(f"WITH {_VERSIONS} SELECT coalesce(b.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'ADDED' WHEN n.p_partkey IS NULL THEN 'REMOVED' WHEN b.p_size IS DISTINCT FROM n.p_size OR b.p_name IS DISTINCT FROM n.p_name OR b.p_retailprice IS DISTINCT FROM n.p_retailprice THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change FROM base b FULL JOIN nxt n ON b.p_partkey = n.p_partkey")
def join_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.diff(*part_versions(spark, sf_dir), ["p_partkey"])


_TARGETS = "SELECT o_orderkey AS id, o_custkey AS metric, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + (CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 30 WHEN 3 THEN 365 ELSE 3650 END)::INTEGER AS e FROM orders"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of customers that hold for a day, a week, a month, a year or ten years, from their orders."""
    k, start = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    days = F.when(k == 0, 0).when(k == 1, 6).when(k == 2, 30).when(k == 3, 365).otherwise(3650)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("metric"), start.alias("s"), F.date_add(start, days).alias("e"))


@query(f"WITH t AS ({_TARGETS}) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.metric = b.metric AND a.id < b.id AND a.s <= b.e AND a.e >= b.s")
def join_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of intervals of mixed lengths, which meet in buckets as wide as the longer one."""
    return J.overlaps(targets(spark, sf_dir), "id", "metric", "s", "e")


@query("SELECT p_type AS alias, count(DISTINCT p_brand) AS n_targets FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases with different targets: one pass by alias instead of a self join by `!=`."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("alias")).agg(F.count_distinct("p_brand").alias("n_targets")).where("n_targets > 1")


@query("WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(DISTINCT p_partkey) AS n_rules FROM w GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def join_trigger_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger words that several rules share."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count_distinct("p_partkey").alias("n_rules")).where("n_rules > 1")


_MONTHLY = "SELECT c_mktsegment AS segment, DATE '1995-01-01' + (c_custkey % 24 * 100)::INTEGER AS effective, max(c_acctbal) AS target FROM customer GROUP BY 1, 2"


def monthly_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    effective = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 24 * 100).cast("int"))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), effective.alias("effective")).agg(F.max("c_acctbal").alias("target"))


@query(f"WITH t AS ({_MONTHLY}), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o.o_orderkey, t.effective, t.target FROM o ASOF LEFT JOIN t ON o.segment = t.segment AND o.d >= t.effective")
def join_asof_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest target in effect at each order's date: one sort by key and time, no pairs."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("c_mktsegment").alias("segment"))
    return J.as_of(orders, monthly_targets(spark, sf_dir), "segment", "d", "effective", ["effective", "target"]).select("o_orderkey", "effective", "target")


@query("SELECT e.event_id, o.amount FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS amount FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def join_asof_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each event's user at its time; both sides are long, and a user is spread over ranges of time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("from")).agg(F.max("o_totalprice").alias("amount"))
    return J.as_of_sorted(events, orders, "user_id", "ts", "from", ["amount"]).select("event_id", "amount")


@query(f"WITH t AS ({_TARGETS}) SELECT l_orderkey, l_linenumber, t.id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN t ON o_custkey = t.metric AND CAST(l_shipdate AS DATE) BETWEEN t.s AND t.e")
def join_range_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of a line's customer that hold on the day it is shipped."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), F.col("o_custkey").alias("metric"))
    return J.contained(lines, targets(spark, sf_dir), "metric", "d", "s", "e").select("l_orderkey", "l_linenumber", "id")


@query("WITH k AS (SELECT p_name, count(*) AS n FROM (SELECT CASE p_partkey WHEN 7 THEN 'one of a kind' ELSE p_name END AS p_name FROM part) GROUP BY 1), w AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'no part' ELSE 'one of a kind' END AS name FROM supplier) SELECT s_suppkey, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN n = 1 THEN 'UNIQUE' ELSE 'MULTIPLE' END AS outcome FROM w LEFT JOIN k ON name = p_name")
def join_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(F.lit("red ring"), F.lit("no part"), F.lit("one of a kind")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("name"))
    have = table(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") == 7, "one of a kind").otherwise(F.col("p_name")))
    return J.classify(wanted, have, "name", "p_name").select("s_suppkey", "outcome")


@query("WITH m(prefix, strip, add) AS (VALUES ('http://', 'http://', 'h/'), ('https://', 'https://', 's/'), ('https://m.', 'https://m.', 'mobile/')), f AS (SELECT page_id, url, strip, add, count(*) OVER (PARTITION BY page_id) AS n FROM pages JOIN m ON starts_with(url, prefix)) SELECT page_id, CASE WHEN n = 1 THEN add || substr(url, length(strip) + 1) END AS route, n AS n_mappings FROM f WHERE n = 1 UNION ALL SELECT page_id, NULL, max(n) FROM f WHERE n > 1 GROUP BY page_id")
def join_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls through the one prefix mapping that applies; none if several do."""
    mappings = [("http://", "h/"), ("https://", "s/"), ("https://m.", "mobile/")]
    return J.map_prefixes(table(spark, sf_dir, "pages").select("page_id", "url"), "url", mappings).where("n_mappings > 0").select("page_id", "route", "n_mappings")


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders) GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def join_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have orders of every priority."""
    orders = table(spark, sf_dir, "orders")
    return J.divide(orders, "o_custkey", "o_orderpriority", orders.select("o_orderpriority").distinct())


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND ts >= '2024-01-05' AND ts < '2024-01-16' GROUP BY 1 HAVING count(*) >= 2")
def join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-16'")
    return bought.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables of five rows."""
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("a")).crossJoin(region.select(F.col("r_name").alias("b")))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS covered, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS complete")
def join_denominators_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two key sets are equal: neither has a key that the other lacks."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    one = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count(F.lit(1)) == 0).alias("covered"))
    return one.crossJoin(customers.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count(F.lit(1)) == 0).alias("complete")))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS usual FROM orders) WHERE o_totalprice > 2 * usual")
def join_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated subquery (orders of over twice the customer's average) as one aggregate and a join."""
    orders = table(spark, sf_dir, "orders")
    usual = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("usual"))
    return orders.join(usual, "o_custkey").where("o_totalprice > 2 * usual").select("o_orderkey", "o_totalprice")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT c_custkey, n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f ON o_custkey = c_custkey AND k = 1")
def join_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment: inner by key, and left with the first match only."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", "o_orderkey")
