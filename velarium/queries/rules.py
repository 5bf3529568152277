"""Business rules over customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import joins as J
from velarium.operators import projection as P
from velarium.operators import rules as R
from velarium.registry import query, register
from velarium.session import table

_V = "CASE WHEN ({}) IS NULL THEN 'UNKNOWN' WHEN {} THEN 'PASS' ELSE 'FAIL' END AS verdict"


def _sql(test: str) -> str:
    return _V.format(test, test)


_SPENT = "SELECT c_custkey, c_mktsegment, sum(o_totalprice) AS spent, avg(o_totalprice) AS mean, max(o_totalprice) AS top, max(CAST(o_orderdate AS DATE)) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"), F.max(F.to_date("o_orderdate")).alias("last"))
    return table(spark, sf_dir, "customer").join(sums, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_mktsegment", "spent", "mean", "top", "last")


@query(f"SELECT c_custkey, {_sql('spent >= 1500000')} FROM ({_SPENT})")
def rule_comparison_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spent(spark, sf_dir).select("c_custkey", R.verdict(R.compare(F.col("spent"), ">=", F.lit(1500000))).alias("verdict"))


_TARGET = "SELECT c_mktsegment AS segment, DATE '1995-01-01' + (c_custkey % 24 * 100)::INTEGER AS effective, max(c_acctbal) AS target FROM customer GROUP BY 1, 2"


@query(f"WITH s AS ({_SPENT}), t AS ({_TARGET}) SELECT c_custkey, {_sql('mean >= target * 15')} FROM s ASOF LEFT JOIN t ON s.c_mktsegment = t.segment AND s.last >= t.effective")
def rule_comparison_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the target in effect, times a ratio."""
    from velarium.queries.joins import monthly_targets

    rows = J.as_of(spent(spark, sf_dir).withColumnRenamed("c_mktsegment", "segment"), monthly_targets(spark, sf_dir), "segment", "last", "effective", ["target"])
    return rows.select("c_custkey", R.verdict(F.col("mean") >= F.col("target") * 15).alias("verdict"))


@query(f"SELECT c_custkey, {_sql('top > 2 * mean')} FROM ({_SPENT})")
def rule_comparison_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spent(spark, sf_dir).select("c_custkey", R.verdict(F.col("top") > 2 * F.col("mean")).alias("verdict"))


_RICH = "c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'"


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", R.verdict(F.expr(_RICH)).alias("verdict"))


register("rule_filter", rich, f"SELECT c_custkey, {_sql(_RICH)} FROM customer")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '1998-01-01' AND o_orderdate < '1999-01-01') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM customer")
def rule_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event is there in a window; found keys are reduced before the join."""
    found = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1998-01-01' AND o_orderdate < TIMESTAMP_NTZ'1999-01-01'").select("o_custkey").distinct()
    return table(spark, sf_dir, "customer").join(found, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", R.verdict(F.col("o_custkey").isNotNull()).alias("verdict"))


@query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, CASE WHEN coalesce(n, 0) >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM customer LEFT JOIN n ON o_custkey = c_custkey")
def rule_existence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", R.verdict(F.coalesce("n", F.lit(0)) >= 3).alias("verdict"))


_BOTH = f"SELECT s.c_custkey, spent >= 1500000 AS a, {_RICH.replace('c_mktsegment', 'c.c_mktsegment')} AS b FROM ({_SPENT}) s JOIN customer c USING (c_custkey)"
for _name, _logic, _negated, _test in (("and", "AND", False, "a AND b"), ("or", "OR", True, "a OR NOT b"), ("not", "NOT", False, "NOT a")):
    register(f"rule_composite_{_name}", lambda spark, sf_dir, g=_logic, n=_negated: R.combine([(rule_comparison_const(spark, sf_dir), False), (rich(spark, sf_dir), n)], "c_custkey", g), f"SELECT c_custkey, {_sql(_test)} FROM ({_BOTH})")


@query(f"SELECT c_custkey, {_sql(f'NOT ({_RICH})')} FROM customer")
def rule_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.combine([(rich(spark, sf_dir), True)], "c_custkey", "AND")


@query(f"SELECT verdict, count(*) AS n FROM (SELECT {_sql('spent >= 1500000')} FROM ({_SPENT})) GROUP BY 1")
def rule_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_comparison_const(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')) AS word FROM part), q(word) AS (VALUES ('ring'), ('small'), ('blue')) SELECT word, min(p_partkey) AS p_partkey FROM w JOIN q USING (word) GROUP BY 1")
def rule_trigger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a question to the rule of the highest priority (the least number)."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.where(F.col("word").isin("ring", "small", "blue")).groupBy("word").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT s_suppkey, coalesce(metric_target, event_target, entity_target, 'UNRESOLVED') AS target FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'metric:' || s_suppkey END AS metric_target, CASE WHEN s_suppkey % 3 = 0 THEN 'event:' || s_suppkey END AS event_target, CASE WHEN s_suppkey % 2 = 0 THEN 'entity:' || s_suppkey END AS entity_target FROM supplier)")
def rule_target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object that a rule's key names: a metric before an event before an entity."""
    supplier = table(spark, sf_dir, "supplier")
    coded = lambda n: supplier.where(F.col("s_suppkey") % n == 0).select(F.col("s_suppkey").alias("code"), F.col("s_suppkey").alias("name"))
    rules = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("target"), F.lit(None).cast("long").alias("owner"))
    found = P.resolve_targets(rules, coded(5), coded(3), coded(2))
    return found.select(F.col("id").alias("s_suppkey"), F.coalesce(F.concat(F.lower("target_type"), F.lit(":"), F.col("name").cast("string")), F.lit("UNRESOLVED")).alias("target"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events WHERE NOT (user_id % 50 = 0 OR event_type = 'error') GROUP BY 1")
def rule_traffic_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bots and internal tests don't count."""
    excluded = (F.col("user_id") % 50 == 0) | (F.col("event_type") == "error")
    return table(spark, sf_dir, "events").where(~excluded).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
