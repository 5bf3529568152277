"""Validation checks, one query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import joins as J
from velarium.operators import quality as Q
from velarium.queries.graphs import tree
from velarium.queries.joins import _TARGETS, targets
from velarium.registry import query, register
from velarium.session import table


def _check(name: str, build, sql: str) -> None:
    register(name, build, sql)


def _t(name: str, *changes):
    """A table, with some columns replaced."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        for column, expression in changes:
            df = df.withColumn(column, F.expr(expression))
        return df

    return build


_part, _supplier, _customer, _orders, _lines = (_t(n) for n in ("part", "supplier", "customer", "orders", "lineitem"))

_check("dq_duplicate_alias", lambda s, d: Q.ambiguous(_part(s, d), "TERM_ALIAS_CONFLICT", "p_type", "p_brand"), "SELECT 'TERM_ALIAS_CONFLICT' AS code, p_type AS key, CAST(count(DISTINCT p_brand) AS VARCHAR) AS detail FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1")
_coded = _t("part", ("c", "concat('P', p_partkey % 150)"))
_check("dq_duplicate_code", lambda s, d: Q.duplicates(_coded(s, d), "DUPLICATE_ENTITY_CODE", "c"), "SELECT 'DUPLICATE_ENTITY_CODE' AS code, 'P' || p_partkey % 150 AS key, CAST(count(*) AS VARCHAR) AS detail FROM part GROUP BY 2 HAVING count(*) > 1")
_check("dq_duplicate_event_key", lambda s, d: Q.duplicates(_lines(s, d).withColumn("k", F.concat_ws("/", "l_orderkey", "l_linenumber")), "DUPLICATE_EVENT_CODE", "k"), "SELECT 'DUPLICATE_EVENT_CODE' AS code, l_orderkey || '/' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY 2 HAVING count(*) > 1")
_gaps = _t("customer", ("c_name", "CASE WHEN c_custkey % 40 = 0 THEN '' ELSE c_name END"), ("c_mktsegment", "CASE WHEN c_custkey % 60 = 0 THEN NULL ELSE c_mktsegment END"))
_check("dq_missing_required", lambda s, d: Q.missing(_gaps(s, d), "MISSING_METRIC_NAME", "c_custkey", "c_name", "c_mktsegment"), "SELECT 'MISSING_METRIC_NAME' AS code, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 120 = 0 THEN 'c_name,c_mktsegment' WHEN c_custkey % 40 = 0 THEN 'c_name' ELSE 'c_mktsegment' END AS detail FROM customer WHERE c_custkey % 40 = 0 OR c_custkey % 60 = 0")
_check("dq_missing_mapping", lambda s, d: Q.dangling(_part(s, d), "MISSING_FIELD_MAPPING", "p_partkey", "p_partkey", _lines(s, d).where("l_quantity >= 49"), "l_partkey"), "SELECT 'MISSING_FIELD_MAPPING' AS code, CAST(p_partkey AS VARCHAR) AS key, CAST(p_partkey AS VARCHAR) AS detail FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
_shifted = _t("orders", ("o_custkey", "CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey - 1 ELSE o_custkey END"))
_check("dq_dangling_relation", lambda s, d: Q.dangling(_shifted(s, d), "MISSING_JOIN_KEY_MAPPING", "o_orderkey", "o_custkey", _customer(s, d), "c_custkey"), "SELECT 'MISSING_JOIN_KEY_MAPPING' AS code, CAST(o_orderkey AS VARCHAR) AS key, CAST(k AS VARCHAR) AS detail FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)")
_check("dq_level_in_use", lambda s, d: Q.in_use(table(s, d, "nation"), "LEVEL_IN_USE", "n_nationkey", _supplier(s, d), "s_nationkey"), "SELECT 'LEVEL_IN_USE' AS code, CAST(s_nationkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey")
_check("dq_active_children", lambda s, d: Q.in_use(_customer(s, d), "ACTIVE_CHILDREN", "c_custkey", _orders(s, d).where("o_orderstatus = 'O'"), "o_custkey"), "SELECT 'ACTIVE_CHILDREN' AS code, CAST(o_custkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY o_custkey")
_check("dq_invalid_dates", lambda s, d: Q.failing(_lines(s, d).join(_orders(s, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n")), "INVALID_TARGET_DATE", "l_orderkey", F.col("n") > 0, "n"), "SELECT 'INVALID_TARGET_DATE' AS code, CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY l_orderkey")
_check("dq_ratio_out_of_range", lambda s, d: Q.failing(_lines(s, d).groupBy("l_partkey").agg(F.max("l_discount").alias("r")), "TARGET_RATIO_OUT_OF_RANGE", "l_partkey", (F.col("r") < 0) | (F.col("r") > 0.099), F.round("r", 2)), "SELECT 'TARGET_RATIO_OUT_OF_RANGE' AS code, CAST(l_partkey AS VARCHAR) AS key, CAST(round(max(l_discount), 2) AS VARCHAR) AS detail FROM lineitem GROUP BY l_partkey HAVING max(l_discount) < 0 OR max(l_discount) > 0.099")
_check("dq_illegal_operator", lambda s, d: Q.failing(s.createDataFrame([("p_name", "TEXT", "SUM"), ("p_size", "NUMBER", "SUM"), ("p_partkey", "ID", "AVG"), ("p_brand", "ENUM", "COUNT")], "attribute string, kind string, operator string"), "INVALID_METRIC_BASE_ATTRIBUTE", "attribute", F.col("kind").isin("TEXT", "ID", "CODE", "FOREIGN_KEY") & ~F.col("operator").isin("COUNT", "COUNT_DISTINCT"), "operator"), "SELECT 'INVALID_METRIC_BASE_ATTRIBUTE' AS code, a AS key, o AS detail FROM (VALUES ('p_name', 'SUM'), ('p_partkey', 'AVG')) t(a, o)")
_check("dq_empty_filter", lambda s, d: Q.failing(_part(s, d).select("p_partkey", F.split(F.when(F.col("p_partkey") % 30 == 0, " , ").otherwise(F.col("p_type")), ",").alias("v")), "EMPTY_FILTER_VALUE", "p_partkey", F.size(F.filter("v", lambda x: F.trim(x) != "")) == 0, F.lit("values")), "SELECT 'EMPTY_FILTER_VALUE' AS code, CAST(p_partkey AS VARCHAR) AS key, 'values' AS detail FROM part WHERE p_partkey % 30 = 0")


@query(f"WITH t AS ({_TARGETS}) SELECT 'METRIC_TARGET_OVERLAP' AS code, CAST(id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT a.id FROM t a JOIN t b ON a.metric = b.metric AND a.id < b.id AND a.s <= b.e AND a.e >= b.s) GROUP BY id")
def dq_target_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.overlaps(targets(spark, sf_dir), "id", "metric", "s", "e").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return Q.failing(found, "METRIC_TARGET_OVERLAP", "a", F.lit(True), "n")


_TREE = "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 70 = 0 THEN 'r0' ELSE 'n' || c_nationkey END FROM customer"


@query(f"SELECT 'INVALID_VALUE_PARENT' AS code, node AS key, parent AS detail FROM ({_TREE}) WHERE node LIKE 'c%' AND parent LIKE 'r%'")
def dq_parent_one_level_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's parent must be exactly one level up."""
    level = lambda c: F.when(F.col(c).startswith("r"), 1).when(F.col(c).startswith("n"), 2).otherwise(3)
    rows = tree(spark, sf_dir).withColumn("parent", F.when(F.col("node").startswith("c") & (F.expr("cast(substr(node, 2) as long)") % 70 == 0), "r0").otherwise(F.col("parent")))
    return Q.failing(rows.where("parent IS NOT NULL"), "INVALID_VALUE_PARENT", "node", level("parent") != level("node") - 1, "parent")


@query("SELECT 'VALUE_CYCLE' AS code, CAST(s_suppkey AS VARCHAR) AS key, CAST(CASE WHEN s_suppkey % 6 = 5 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS VARCHAR) AS detail FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey - s_suppkey % 6 + 5 <= (SELECT max(s_suppkey) FROM supplier)")
def dq_value_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velarium.queries.graphs import hier_cycle

    on_cycle = hier_cycle(spark, sf_dir)
    return Q.failing(on_cycle, "VALUE_CYCLE", "node", F.lit(True), F.when(F.col("node") % 6 == 5, F.col("node") - 4).otherwise(F.col("node") + 1))


_TRIG = "SELECT p_partkey AS rule, unnest(string_split(lower(p_name), ' ')) AS word, p_partkey % 3 <> 0 AS active FROM part"


@query(f"SELECT 'TRIGGER_WORD_CONFLICT' AS code, word AS key, CAST(count(DISTINCT rule) AS VARCHAR) AS detail FROM ({_TRIG}) WHERE active GROUP BY word HAVING count(DISTINCT rule) > 1")
def dq_trigger_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return Q.ambiguous(words, "TRIGGER_WORD_CONFLICT", "word", "p_partkey")


@query("WITH p AS (SELECT s_suppkey AS a, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey - 1 WHEN s_suppkey % 9 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS b FROM supplier) SELECT 'OPPOSITE_NOT_FOUND' AS code, CAST(x.a AS VARCHAR) AS key, CAST(x.b AS VARCHAR) AS detail FROM p x LEFT JOIN p y ON x.b = y.a AND y.b = x.a WHERE y.a IS NULL")
def dq_opposite_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's opposite must name it back."""
    key = F.col("s_suppkey")
    pairs = table(spark, sf_dir, "supplier").select(key.alias("a"), F.when(key % 2 == 0, key - 1).when(key % 9 == 0, key).otherwise(key + 1).alias("b"))
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return Q.failing(pairs.join(back, ["a", "b"], "left_anti"), "OPPOSITE_NOT_FOUND", "a", F.lit(True), "b")


@query("WITH d AS (SELECT count(*) AS n FROM (SELECT p_partkey % 150 AS k FROM part GROUP BY 1 HAVING count(*) > 1)), m AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 40 = 0 OR c_custkey % 60 = 0) SELECT d.n AS n_blockers, m.n AS n_warnings, d.n = 0 AS publishable FROM d, m")
def dq_publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.duplicates(_coded(spark, sf_dir), "DUPLICATE_ENTITY_CODE", "c").unionByName(Q.missing(_gaps(spark, sf_dir), "MISSING_METRIC_NAME", "c_custkey", "c_name", "c_mktsegment"))
    return Q.gate(found, ("DUPLICATE_ENTITY_CODE",))
