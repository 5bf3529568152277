"""Predicates, sorting, top-k and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions.conditions import combine, facets
from velarium.operators import paging
from velarium.plans.model import Condition
from velarium.registry import query, register
from velarium.session import table

_PART = "SELECT p_partkey, p_name, p_size FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS p_size FROM part) WHERE "


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, with a size missing in a tenth of them."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("p_size"))


for _name, _operator, _values, _sql in (
    ("eq", "=", (7,), "p_size = 7"), ("ne", "!=", (7,), "p_size <> 7"), ("gt", ">", (40,), "p_size > 40"), ("ge", ">=", (40,), "p_size >= 40"), ("lt", "<", (5,), "p_size < 5"), ("le", "<=", (5,), "p_size <= 5"),
    ("in", "IN", (1, 2, 3), "p_size IN (1, 2, 3)"), ("not_in", "NOT_IN", (1, 2, 3), "p_size NOT IN (1, 2, 3)"), ("between", "BETWEEN", (10, 12), "p_size BETWEEN 10 AND 12"),
    ("is_null", "IS_NULL", (), "p_size IS NULL"), ("not_null", "NOT_NULL", (), "p_size IS NOT NULL"),
):
    register(f"filter_{_name}", lambda spark, sf_dir, c=Condition("p_size", _operator, _values): _parts(spark, sf_dir).where(combine([c])), _PART + _sql)
register("filter_like", lambda spark, sf_dir: _parts(spark, sf_dir).where(combine([Condition("p_name", "LIKE", ("%ring%",))])), _PART + "p_name LIKE '%ring%'")
register("filter_any", lambda spark, sf_dir: _parts(spark, sf_dir).where(combine([Condition("p_size", "<", (3,)), Condition("p_size", "IS_NULL")], "OR")), _PART + "p_size < 3 OR p_size IS NULL")
register("filter_none", lambda spark, sf_dir: _parts(spark, sf_dir).where(combine([])), _PART + "true")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), lower('#0000001'))")
def filter_facets_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(facets({"c_mktsegment": ["BUILDING", "FURNITURE"], "c_nationkey": []}, "#0000001", ["c_name", "c_mktsegment"])).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') OR list_contains(string_split(p_name, ' '), 'bolt')")
def filter_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.split("p_name", " ")
    return table(spark, sf_dir, "part").where(F.array_contains(tags, "ring") | F.array_contains(tags, "bolt")).select("p_partkey", "p_name")


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%1%' UNION SELECT r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%1%'")
def filter_tree_keeps_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching members and all that stands above them."""
    found = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("n_name").contains("1")).select("r_name", "n_name")
    return found.union(found.select("r_name", F.lit(None).cast("string"))).distinct()


@query("SELECT user_id, count(*) AS n FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1 HAVING count(*) >= 4")
def filter_revision_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to a revision (here the middle one); groups that are large enough."""
    events = table(spark, sf_dir, "events")
    revision = events.agg(F.expr("max(event_id) div 2").alias("revision"))  # one row
    return events.join(F.broadcast(revision), F.col("event_id") <= F.col("revision")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


_NULLS = "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS p_size FROM part)"


@query(f"SELECT * FROM ({_NULLS}) WHERE place <= 100")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred in an order with NULLs last; the place comes from a top-k, not a sort of all rows."""
    return paging.numbered(_parts(spark, sf_dir).select("p_partkey", "p_size"), [F.col("p_size").desc_nulls_last(), F.col("p_partkey").asc()], 100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, c_name FROM customer WHERE (c_name, c_custkey) > ((SELECT c_name FROM customer WHERE c_custkey = 40), 40) ORDER BY c_name, c_custkey LIMIT 20")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    last = customers.where("c_custkey = 40").first()
    return paging.keyset(customers, ["c_name", "c_custkey"], 20, after=(last.c_name, last.c_custkey))


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey < 100 ORDER BY c_custkey DESC LIMIT 20)")
def page_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.keyset(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, before=(100,))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(40).limit(20)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT (SELECT CASE WHEN count(*) % 20 = 0 THEN 20 ELSE count(*) % 20 END FROM customer)")
def page_number_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page number beyond the last page gives the last."""
    return paging.page(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 10**9)


@query("SELECT version, CAST(substr(version, 2) AS INTEGER) AS number FROM (SELECT 'V' || l_linenumber AS version FROM lineitem GROUP BY 1) ORDER BY 2")
def sort_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 comes before V10."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("V"), "l_linenumber").alias("version")).distinct().withColumn("number", F.expr("cast(substr(version, 2) as int)")).orderBy("number")
