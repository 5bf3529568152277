"""Aggregations: basic, composite, semi-additive and derived metrics."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions.timex import TimeRule, resolve
from velarium.operators.metrics import compute, latest_snapshot
from velarium.plans.catalog import STAR
from velarium.plans.model import Attribute as A
from velarium.plans.model import BasicMetric as M
from velarium.plans.model import Catalog, CompositeMetric, Condition
from velarium.registry import query, register
from velarium.session import table


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _metric(name: str, metrics: list, dimensions: tuple[str, ...], sql: str, **options) -> None:
    register(name, lambda spark, sf_dir: rounded(compute(spark, sf_dir, metrics, dimensions, **options)), sql)


FLAG = ("sales_line.l_returnflag",)
_metric("metric_sum", [M("total_quantity", "sales_line", "SUM", "l_quantity"), M("total_revenue", "sales_line", "$sum", "revenue")], FLAG, "SELECT l_returnflag, sum(l_quantity) AS total_quantity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem GROUP BY 1")
_metric("metric_avg", [M("avg_price", "sales_line", "AVG", "l_extendedprice")], ("part.p_brand",), "SELECT p_brand, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
_metric("metric_count", [M("n_orders", "order", "COUNT", "o_orderkey")], ("order.o_orderpriority",), "SELECT o_orderpriority, count(o_orderkey) AS n_orders FROM orders GROUP BY 1")
_metric("metric_count_distinct", [M("n_customers", "order", "COUNT_DISTINCT", "o_custkey")], ("order.o_orderstatus",), "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1")
_metric("metric_minmax", [M("least", "order", "MIN", "o_totalprice"), M("most", "order", "MAX", "o_totalprice")], ("order.o_orderstatus",), "SELECT o_orderstatus, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most FROM orders GROUP BY 1")
_R, _BIG = Condition("l_returnflag", "=", ("R",)), Condition("l_quantity", ">", (30,))
_metric("metric_caliber_and", [M("returned_big", "sales_line", "SUM", "l_quantity", (_R, _BIG))], ("sales_line.l_linestatus",), "SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN l_quantity END) AS returned_big FROM lineitem GROUP BY 1")
_metric("metric_caliber_or", [M("returned_or_big", "sales_line", "COUNT", "l_orderkey", (_R, _BIG), "OR")], ("sales_line.l_linestatus",), "SELECT l_linestatus, count(CASE WHEN l_returnflag = 'R' OR l_quantity > 30 THEN l_orderkey END) AS returned_or_big FROM lineitem GROUP BY 1")
_AMOUNT, _COUNT = M("order_amount", "order", "SUM", "o_totalprice"), M("order_count", "order", "COUNT_DISTINCT", "o_orderkey")
_metric("metric_ratio", [_AMOUNT, _COUNT, CompositeMetric("aov", "order_amount / order_count")], ("customer.c_mktsegment",), "SELECT c_mktsegment, round(sum(o_totalprice) / nullif(count(DISTINCT o_orderkey), 0), 4) AS aov FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", keep=["aov"])
_DONE = M("done_amount", "order", "SUM", "o_totalprice", (Condition("o_orderstatus", "=", ("F",)),))
_metric(
    "metric_composite_nested",
    [_AMOUNT, _COUNT, _DONE, CompositeMetric("aov", "order_amount / order_count"), CompositeMetric("done_share", "done_amount / order_amount"), CompositeMetric("score", "(aov - 1000) * done_share + 2 * 3")],
    ("nation.n_name",),
    """WITH a AS (SELECT n_name, sum(o_totalprice) AS t, count(DISTINCT o_orderkey) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS d
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT n_name, round(t / n, 4) AS aov, round(d / nullif(t, 0), 4) AS done_share, round((t / n - 1000) * (d / nullif(t, 0)) + 6, 4) AS score FROM a""",
    keep=["aov", "done_share", "score"],
)
_metric(
    "metric_cross_event",
    [M("line_revenue", "sales_line", "SUM", "revenue"), _AMOUNT, CompositeMetric("line_share", "line_revenue / order_amount")],
    ("nation.n_name",),
    """WITH l AS (SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
        o AS (SELECT n_name, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT coalesce(l.n_name, o.n_name) AS n_name, round(r, 4) AS line_revenue, round(t, 4) AS order_amount, round(r / nullif(t, 0), 4) AS line_share FROM l FULL JOIN o ON l.n_name IS NOT DISTINCT FROM o.n_name""",
)
_metric("metric_row_then_sum", [M("total_revenue", "sales_line", "SUM", "revenue")], ("sales_line.l_linestatus",), "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem GROUP BY 1")
_metric("metric_floor_zero", [M("over_half", "sales_line", "SUM", "over_half")], FLAG, "SELECT l_returnflag, sum(greatest(l_quantity - 25, 0)) AS over_half FROM lineitem GROUP BY 1")
_metric("metric_median", [M("median_price", "order", "MEDIAN", "o_totalprice")], ("order.o_orderpriority",), "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median_price FROM orders GROUP BY 1")
_metric("dimension_filter", [_AMOUNT], ("nation.n_name", "customer.c_mktsegment"), "SELECT n_name, c_mktsegment, round(sum(o_totalprice), 4) AS order_amount FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'FURNITURE' GROUP BY 1, 2", where=(Condition("c_mktsegment", "=", ("FURNITURE",)),))
_metric(
    "join_role_playing", [M("total_quantity", "sales_line", "SUM", "l_quantity")], ("nation.n_name", "supplier_nation:nation.n_name"),
    """SELECT cn.n_name AS n_name, sn.n_name AS supplier_nation_n_name, sum(l_quantity) AS total_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average order value by nation, of furniture customers, in the year before mid-1998."""
    year = resolve(TimeRule("OFFSET", "YEAR", -1), date(1998, 6, 30))
    metrics = [_AMOUNT, _COUNT, CompositeMetric("aov", "order_amount / order_count")]
    return rounded(compute(spark, sf_dir, metrics, ("nation.n_name", "customer.c_mktsegment"), period=year, where=(Condition("c_mktsegment", "=", ("FURNITURE",)),)))


register(
    "metric_aov_by_nation", flagship,
    """SELECT n_name, c_mktsegment, round(sum(o_totalprice), 4) AS order_amount, count(DISTINCT o_orderkey) AS order_count, round(sum(o_totalprice) / nullif(count(DISTINCT o_orderkey), 0), 4) AS aov
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        WHERE c_mktsegment = 'FURNITURE' AND o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' GROUP BY 1, 2""",
)


@query("SELECT flag0 AS flag, round(100 * sum(on_time) / nullif(sum(valid), 0), 4) AS on_time_rate FROM (SELECT l_returnflag AS flag0, CASE WHEN l_shipdate >= o_orderdate THEN 1 ELSE 0 END AS valid, CASE WHEN l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END AS on_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def metric_weighted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid lines shipped within 60 days, in percent; NULL without valid lines."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    valid = F.col("l_shipdate") >= F.col("o_orderdate")
    on_time = valid & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(100 * F.sum(on_time.cast("int")) / F.nullif(F.sum(valid.cast("int")), F.lit(0)), 4).alias("on_time_rate"))


_SNAPSHOT = "SELECT event_type, CAST(ts AS DATE) AS day, value FROM events"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), F.col("value"))


@query(f"WITH s AS (SELECT * FROM ({_SNAPSHOT}) WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') SELECT event_type, round(sum(value), 4) AS value, day FROM s WHERE day = (SELECT max(day) FROM s) GROUP BY event_type, day")
def metric_semi_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(latest_snapshot(_snapshots(spark, sf_dir), "day", "value", ("event_type",), (date(2024, 1, 5), date(2024, 1, 20))))


@query(f"WITH s AS ({_SNAPSHOT}), g AS (SELECT event_type, day, sum(value) AS v FROM s GROUP BY 1, 2) SELECT event_type, round(max_by(v, day), 4) AS value, max(day) AS day FROM g GROUP BY 1")
def metric_semi_additive_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(latest_snapshot(_snapshots(spark, sf_dir), "day", "value", ("event_type",), per_key=True))


def _stock() -> Catalog:
    """Orders as states of a stock: amounts count at the latest month only, ages are never summed, and months in stock only within a customer."""
    months = "(2000 - year(o_orderdate)) * 12 - month(o_orderdate)"
    attributes = (
        *STAR.objects["order"].attributes, A("at", "DATETIME", transform="to_date(date_trunc('MONTH', o_orderdate))"), A("stock", "AMOUNT", transform="o_totalprice", additivity="semi"),
        A("age", "NUMBER", transform="datediff(date '2000-01-01', o_orderdate)", additivity="none"), A("months", "NUMBER", transform=months, additivity="none", within=("o_custkey",)),
    )
    return replace(STAR, objects=STAR.objects | {"order": replace(STAR.objects["order"], attributes=attributes, default_time="at")})


@query("""WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-01'), l AS (SELECT max(month) AS last FROM o)
    SELECT c_mktsegment, round(sum(o_totalprice) FILTER (month = last), 2) AS stock, round(sum(o_totalprice) FILTER (month = last AND o_orderstatus = 'O'), 2) AS stock_open, count(*) AS n, round(avg(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')), 4) AS age, median(o_totalprice) AS middle FROM o JOIN customer ON c_custkey = o_custkey, l GROUP BY 1""")
def metric_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-additive metrics beside additive ones, an average that is never a sum, and a median."""
    asked = [
        M("stock", "order", "SUM", "stock"), M("stock_open", "order", "SUM", "stock", (Condition("o_orderstatus", "=", ("O",)),)), M("n", "order", "COUNT"),
        M("age", "order", "AVG", "age"), M("middle", "order", "MEDIAN", "o_totalprice"),
    ]
    found = compute(spark, sf_dir, asked, ("customer.c_mktsegment",), (date(1900, 1, 1), date(1998, 3, 31)), catalog=_stock())
    return found.select("c_mktsegment", F.round("stock", 2).alias("stock"), F.round("stock_open", 2).alias("stock_open"), "n", F.round("age", 4).alias("age"), "middle")


@query("SELECT o_custkey, sum((2000 - year(o_orderdate)) * 12 - month(o_orderdate))::BIGINT AS months FROM orders GROUP BY 1")
def metric_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum that keeps apart what must not be added up."""
    return compute(spark, sf_dir, [M("months", "order", "SUM", "months")], ("order.o_custkey",), catalog=_stock())


@query("SELECT o_orderpriority, round(avg(date_diff('second', o_orderdate, l_shipdate) / 3600.0), 4) AS avg_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1")
def metric_avg_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours are averaged, never summed."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    hours = (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 3600.0
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg(hours), 4).alias("avg_hours"))


@query("SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice * 0.1), 4) AS margin FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def metric_joined_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice * 0.1D")), 4).alias("margin"))


@query("SELECT l_linestatus, round(coalesce(sum(l_extendedprice), 0) - coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0), 4) AS net FROM lineitem GROUP BY 1")
def metric_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales less completed returns; no returns count as zero."""
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)) - F.coalesce(returned, F.lit(0.0)), 4).alias("net"))


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice > 200000) AS n_large, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_done, bool_and(o_totalprice > 0) AS all_positive, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY 1")
def metric_cond_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_done"),
        F.bool_and(F.col("o_totalprice") > 0).alias("all_positive"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"),
    )


_GEO = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"SELECT r_name, n_name, round(sum(o_totalprice), 4) AS amount, count(*) AS n {_GEO} GROUP BY ROLLUP (r_name, n_name)")
def rollup_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geo(spark, sf_dir).rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 4).alias("amount"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.grouping_id().cast("long").alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], F.col("o_orderstatus"), F.col("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (toxic = 0) AS n_clean, count(*) FILTER (quality = 0) AS n_low FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("toxic") == 0).alias("n_clean"), F.count_if(F.col("quality") == 0).alias("n_low"))


@query("SELECT event_type, count(*) FILTER (CAST(ts AS DATE) <= DATE '2024-01-10') AS early, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-10') AS late FROM events GROUP BY 1")
def counts_by_kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind and stage, the stages as columns."""
    stage = F.when(F.to_date("ts") <= F.lit(date(2024, 1, 10)), "early").otherwise("late")
    return table(spark, sf_dir, "events").withColumn("stage", stage).groupBy("event_type").pivot("stage", ["early", "late"]).count().na.fill(0)


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS tag FROM part) GROUP BY 1")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS fingerprint FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a set: the same for any order and repetition."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("n_name")), "\n"), 256).alias("fingerprint"))


@query("SELECT o_custkey, max_by(o_orderpriority, o_totalprice * 1000000 + o_orderkey) AS top_priority, max(o_orderdate) AS last_order, array_to_string(list_sort(list(DISTINCT o_orderstatus))[1:3], ',') AS sample FROM orders GROUP BY 1")
def group_authority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the highest rank, the latest time, and a sample of up to three distinct values, in order."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.col("o_totalprice") * 1000000 + F.col("o_orderkey")).alias("top_priority"), F.max("o_orderdate").alias("last_order"),
        F.array_join(F.slice(F.array_sort(F.collect_set("o_orderstatus")), 1, 3), ",").alias("sample"),
    )


@query("SELECT p_brand, count(DISTINCT p_size) <= 1 AS homogeneous, count(DISTINCT p_size) AS n_sizes FROM part GROUP BY 1")
def unit_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg((F.count_distinct("p_size") <= 1).alias("homogeneous"), F.count_distinct("p_size").alias("n_sizes"))
