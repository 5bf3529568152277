"""Window functions: latest, versions, rolling, to-date, growth and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.operators.ranged import over
from velarium.operators.ranking import places
from velarium.registry import query
from velarium.session import table


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def win_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of each key, as an aggregate: no sort, and partial before the shuffle."""
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("r")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last).select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("SELECT o_orderkey, CASE WHEN before IS NULL THEN 'ADDED' WHEN before = o_orderstatus THEN 'INHERITED' ELSE 'MODIFIED' END AS change FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)")
def win_lag_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version against the one before; a customer with many versions is spread over ranges."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    before = F.col("before")
    return over(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], before=("lag", "o_orderstatus")).select("o_orderkey", F.when(before.isNull(), "ADDED").when(before == F.col("o_orderstatus"), "INHERITED").otherwise("MODIFIED").alias("change"))


_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_type, day, sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::BIGINT AS week FROM ({_DAILY})")
def win_rolling_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over seven days, of daily sums."""
    days = F.datediff("day", F.lit("1970-01-01").cast("date"))
    return _daily(spark, sf_dir).select("event_type", "day", F.sum("n").over(W.partitionBy("event_type").orderBy(days).rangeBetween(-6, 0)).alias("week"))


@query("SELECT o_orderpriority, month, round(sum(amount) OVER (PARTITION BY o_orderpriority, year(month) ORDER BY month), 2) AS ytd, round(sum(amount) OVER (PARTITION BY o_orderpriority, year(month), quarter(month) ORDER BY month), 2) AS qtd FROM (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)")
def win_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "MONTH").alias("month")).agg(F.sum("o_totalprice").alias("amount"))
    to_date = lambda *parts: W.partitionBy("o_orderpriority", *parts).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    year, quarter = F.year("month"), F.quarter("month")
    return months.select("o_orderpriority", "month", F.round(F.sum("amount").over(to_date(year)), 2).alias("ytd"), F.round(F.sum("amount").over(to_date(year, quarter)), 2).alias("qtd"))


@query("SELECT o_orderpriority, year, round(amount / nullif(lag(amount) OVER (PARTITION BY o_orderpriority ORDER BY year), 0) - 1, 4) AS growth FROM (SELECT o_orderpriority, year(o_orderdate)::BIGINT AS year, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)")
def win_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("amount"))
    before = F.lag("amount").over(W.partitionBy("o_orderpriority").orderBy("year"))
    return years.select("o_orderpriority", "year", F.round(F.col("amount") / F.nullif(before, F.lit(0.0)) - 1, 4).alias("growth"))


@query("SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, first_value(p_partkey) OVER u AS f, last_value(p_partkey) OVER u AS l FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), u AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by a column of few values: from counts of these, so that no task sorts a brand's parts; first and last are aggregates."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    whole = F.struct("p_size", "p_partkey")
    sizes = part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("low"), F.max(whole).alias("high"))
    w, all_of = W.partitionBy("p_brand").orderBy("p_size"), W.partitionBy("p_brand")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.select("p_brand", "p_size", (before + 1).alias("r"), F.row_number().over(w).cast("long").alias("d"), F.min("low").over(all_of)["p_partkey"].alias("f"), F.max("high").over(all_of)["p_partkey"].alias("l"))
    return part.join(ranked, ["p_brand", "p_size"]).select("p_partkey", "r", "d", "f", "l")


@query("SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)::BIGINT AS q, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS following FROM supplier")
def win_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of each nation, and who follows; a nation with many suppliers is spread over ranges."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return over(rows, ["s_nationkey"], ["s_acctbal", "s_suppkey"], q=("ntile", 4), following=("lead", "s_suppkey")).select("s_suppkey", "q", "following")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events")
def win_attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next number of each attempt: one more than those before. A user with most of the events is spread over ranges."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return over(rows, ["user_id"], ["ts", "event_id"], attempt=("row_number",)).select("user_id", "event_id", "attempt")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def win_global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global stable rank; no task sorts more than a range of the order."""
    return places(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "place")


@query("SELECT conv_id, bool_and(role <> before OR before IS NULL) AS alternates, count(*) AS n FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1")
def win_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each conversation's turns alternate."""
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", before.alias("before"))
    return rows.groupBy("conv_id").agg(F.bool_and((F.col("role") != F.col("before")) | F.col("before").isNull()).alias("alternates"), F.count(F.lit(1)).alias("n"))
