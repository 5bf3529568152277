"""Bounded walks, matches with collected sides, and the extension points: aggregate and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.operators import hierarchy as H
from velarium.operators import joins as J
from velarium.queries.graphs import _EDGES, edges
from velarium.registry import query
from velarium.session import table


@query("SELECT p_brand, p_type, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS matches FROM (SELECT DISTINCT p_brand, p_type, l_suppkey AS s_suppkey FROM part JOIN lineitem ON p_partkey = l_partkey) GROUP BY 1, 2")
def join_collect_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By (namespace, method): the distinct other sides, in order. Pairs are made distinct first, so lists are as long as the suppliers at most."""
    pairs = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "p_type", "l_suppkey").distinct()
    ordered = F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string"))
    return pairs.groupBy("p_brand", "p_type").agg(F.array_join(ordered, ",").alias("matches"))


_TOKENS = "SELECT p_partkey AS token_id, p_partkey % 40 AS statement, concat('#{', split_part(p_name, ' ', 2), '.id}') AS token FROM part"
_PARAMETERS = "SELECT p_partkey % 40 AS statement, split_part(p_name, ' ', 1) AS name, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) END AS alias FROM part WHERE p_partkey % 3 = 0"


@query(f"WITH t AS ({_TOKENS}), p AS ({_PARAMETERS}) SELECT token_id, regexp_extract(token, '\\{{([^.}}]+)', 1) AS root, (SELECT count(DISTINCT (name, alias)) FROM p WHERE p.statement = t.statement AND coalesce(alias, name) = regexp_extract(token, '\\{{([^.}}]+)', 1)) AS n_parameters FROM t")
def join_parameter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of statements with the parameters of the same statement whose alias, or else name, is their root."""
    table(spark, sf_dir, "part").createOrReplaceTempView("__token_part")
    tokens, parameters = (spark.sql(q.replace("FROM part", "FROM __token_part")) for q in (_TOKENS, _PARAMETERS))
    return J.bind_parameters(tokens, parameters)


@query(f"WITH RECURSIVE e AS ({_EDGES}), w(node, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 8), r AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), b AS (SELECT node, depth, row_number() OVER o AS k, sum(length(CAST(node AS VARCHAR))) OVER o AS chars FROM r WINDOW o AS (ORDER BY depth, node ROWS UNBOUNDED PRECEDING)) SELECT node, depth FROM b WHERE k <= 12 AND chars <= 24")
def graph_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk within budgets of depth, nodes and characters, nearest first; the node budget bounds what the window sorts."""
    near = H.reach(edges(spark, sf_dir), spark.range(5, 6).select(F.col("id").alias("node")), 8).orderBy("depth", "node").limit(12)
    chars = F.sum(F.length(F.col("node").cast("string"))).over(W.orderBy("depth", "node").rowsBetween(W.unboundedPreceding, 0))
    return near.withColumn("chars", chars).where("chars <= 24").select("node", "depth")


@query("SELECT o_custkey, round(sum(o_totalprice * o_totalprice) / sum(o_totalprice), 2) AS weighted FROM orders GROUP BY 1")
def udaf_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of one's own, vectorised. A group is one batch, so this is for groups that fit in memory; the built-ins combine early and have no such bound."""

    @F.pandas_udf("double")
    def weighted(values: pd.Series, weights: pd.Series) -> float:
        return float((values * weights).sum() / weights.sum())

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(weighted("o_totalprice", "o_totalprice"), 2).alias("weighted"))


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of one's own, over a table."""

    @F.udtf(returnType="p_partkey bigint, word string")
    class Words:
        def eval(self, key: int, text: str):
            for word in text.split(" "):
                yield key, word

    spark.udtf.register("velarium_words", Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("__velarium_part")
    return spark.sql("SELECT w.p_partkey, w.word FROM __velarium_part p, LATERAL velarium_words(p.p_partkey, p.p_name) w")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (true AND o_orderstatus = 'F') AND (NULL IS NULL OR o_orderpriority = NULL)")
def filter_dynamic_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that apply only if their parameter is given."""
    given = {"o_orderstatus": "F", "o_orderpriority": None}
    rows = table(spark, sf_dir, "orders")
    for column, value in given.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.select("o_orderkey", "o_orderstatus")
