"""Captures, batches, versions and store checks over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import sqlprofile
from velarium.registry import query
from velarium.session import scratch_dir, table
from velarium.sources import registry, store
from velarium.sources.keyed import KeyedTable


@query("WITH p AS (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand) AS content FROM part), h AS (SELECT max(p_partkey) // 2 AS half FROM part) SELECT DISTINCT 'sha256:' || sha256(content) AS fingerprint, content FROM p, h WHERE p_partkey > half AND content NOT IN (SELECT content FROM p, h WHERE p_partkey <= half)")
def src_capture_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the parts is captured, then the second: what of it isn't in the store yet, which tells by its filters what to read."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content"))
    half = part.agg(F.max("p_partkey")).first()[0] // 2
    held = store.ContentStore(spark, f"{scratch_dir(spark)}/captures-{uuid.uuid4().hex}")
    held.put(part.where(F.col("p_partkey") <= half))
    return held.missing(part.where(F.col("p_partkey") > half)).select(F.col("ref").alias("fingerprint"), "content")


@query("SELECT batch, sha256(string_agg(snapshot, chr(10) ORDER BY snapshot)) AS identity, count(*) AS n FROM (SELECT DISTINCT p_brand AS batch, p_type AS snapshot FROM part) GROUP BY 1")
def src_freeze_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = store.freeze_batch(table(spark, sf_dir, "part").select(F.col("p_brand").alias("batch"), F.col("p_type").alias("snapshot")))
    return frozen.select("batch", "identity", F.size("members").cast("long").alias("n"))


@query("SELECT page_id, 'sha256:' || sha256(html) AS ref FROM pages")
def src_content_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", store.content_ref(F.col("html")).alias("ref"))


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name LIMIT 21")
def src_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.range_scan(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "Customer#00000001")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT 1000000, 1.0")
def src_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = old.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")).unionByName(spark.range(1).select(F.lit(1000000).cast("long").alias("s_suppkey"), F.lit(1.0).alias("s_acctbal")))
    made = KeyedTable.create(old, f"{scratch_dir(spark)}/suppliers-{uuid.uuid4().hex}", ["s_suppkey"], buckets=16)
    return made.upsert(new).rows()


_OLD, _NEW = "SELECT 'c' || s_suppkey AS name, 'csv' AS family, s_name AS config, 2 AS revision FROM supplier WHERE s_suppkey % 4 <> 0", "SELECT 'c' || s_suppkey AS name, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'csv' END AS family, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS config, CASE WHEN s_suppkey % 6 <> 0 THEN 3 ELSE 2 END AS revision FROM supplier"


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.name, CASE WHEN n.family = '' THEN 'error' WHEN o.name IS NULL THEN 'created' WHEN o.config = n.config THEN 'unchanged' WHEN n.revision > o.revision THEN 'updated' ELSE 'conflict' END AS outcome FROM n LEFT JOIN o USING (name)")
def src_import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    old = supplier.where("s_suppkey % 4 <> 0").selectExpr("concat('c', s_suppkey) AS name", "'csv' AS family", "s_name AS config", "2 AS revision")
    new = supplier.selectExpr("concat('c', s_suppkey) AS name", "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'csv' END AS family", "CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, '!') ELSE s_name END AS config", "CASE WHEN s_suppkey % 6 <> 0 THEN 3 ELSE 2 END AS revision")
    return registry.preview_rows(old, new)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name < 'Supplier#000000003' OR s_name >= 'Supplier#000000006'")
def src_range_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only buckets that hold such names are written again."""
    made = KeyedTable.create(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), f"{scratch_dir(spark)}/suppliers-{uuid.uuid4().hex}", ["s_suppkey"], buckets=16)
    return made.delete_range("s_name", "Supplier#000000003", "Supplier#000000006").rows()


_XML = "CASE s_suppkey % 6 WHEN 0 THEN '<!DOCTYPE a><s>x</s>' WHEN 1 THEN concat('<?xml version=\"1.0\"?><s><name>', s_name, '</name></s>') WHEN 2 THEN '<s><name>cut' WHEN 3 THEN 'no markup' WHEN 4 THEN ' ' ELSE concat('<s name=\"', s_name, '\"/>') END"


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'DOCTYPE' WHEN 2 THEN 'UNCLOSED' WHEN 3 THEN 'NOT_XML' WHEN 4 THEN 'EMPTY' END AS rejected, CASE s_suppkey % 6 WHEN 1 THEN s_name END AS name FROM supplier")
def src_admit_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only XML without document types and entities is parsed; of the rest, why not."""
    checked = store.admit_xml(table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_XML} AS xml"), "xml")
    name = F.when(F.col("rejected").isNull() & F.col("xml").contains("<name>"), F.xpath_string(F.when(F.col("rejected").isNull(), F.col("xml")).otherwise("<s/>"), F.lit("s/name")))
    return checked.select("s_suppkey", "rejected", name.alias("name"))


STATEMENTS = (
    ("q1", "SELECT DISTINCT o.o_custkey AS customer, sum(o.o_totalprice) FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY o.o_custkey HAVING sum(o.o_totalprice) > 10 ORDER BY customer DESC NULLS LAST"),
    ("q2", "INSERT INTO t (a, b) SELECT x, y FROM s WHERE x > 1"), ("q3", "UPDATE t SET a = 1 WHERE b = 2"), ("q4", "DELETE FROM t WHERE a IN (SELECT id FROM u)"),
    ("q5", "SELECT a FROM t UNION ALL SELECT b FROM u INTERSECT SELECT c FROM v"), ("q6", "SELECT a FROM ("), ("q7", "SELECT * FROM a CROSS JOIN b FULL JOIN c USING (id)"), ("q8", "CREATE TABLE t (a INT)"),
)


@query()
def sql_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The syntax trees of some statements, node by node."""
    return sqlprofile.profile(spark, STATEMENTS)


#: What each clause of the statements says, by hand.
_CLAUSES = (
    ("q1", "DISTINCT", 0, ""), ("q1", "PROJECTION", 0, "customer"), ("q1", "PROJECTION", 1, "sum"), ("q1", "AGGREGATE", 0, "SUM"), ("q1", "FROM", 0, "orders"), ("q1", "FROM", 1, "customer"), ("q1", "JOIN", 0, "LEFT"), ("q1", "WHERE", 0, ""), ("q1", "GROUP_BY", 0, ""), ("q1", "HAVING", 0, ""), ("q1", "ORDER_BY", 0, ""),
    ("q2", "TARGET", 0, "t"), ("q2", "PROJECTION", 0, "x"), ("q2", "PROJECTION", 1, "y"), ("q2", "FROM", 0, "s"), ("q2", "WHERE", 0, ""), ("q3", "TARGET", 0, "t"), ("q3", "SET", 0, "a"), ("q3", "WHERE", 0, ""), ("q4", "TARGET", 0, "t"), ("q4", "WHERE", 0, ""), ("q4", "SUBQUERY", 0, ""), ("q4", "PROJECTION", 0, "id"), ("q4", "FROM", 0, "u"),
    ("q5", "SET_OPERATION", 0, "UNION"), ("q5", "SET_OPERATION", 1, "INTERSECT"), ("q5", "PROJECTION", 0, "a"), ("q5", "PROJECTION", 1, "b"), ("q5", "PROJECTION", 2, "c"), ("q5", "FROM", 0, "t"), ("q5", "FROM", 1, "u"), ("q5", "FROM", 2, "v"),
    ("q7", "PROJECTION", 0, "*"), ("q7", "FROM", 0, "a"), ("q7", "FROM", 1, "b"), ("q7", "FROM", 2, "c"), ("q7", "JOIN", 0, "FULL"), ("q7", "JOIN", 1, "CROSS"), ("q7", "USING", 0, "id"),
    ("q9", "PROJECTION", 0, "a"), ("q9", "PROJECTION", 1, "r"), ("q9", "WINDOW", 0, "row_number"), ("q9", "FROM", 0, "t"), ("q9", "LIMIT", 0, "5"),
)


@query("SELECT * FROM (VALUES " + ", ".join(map(str, _CLAUSES)) + ") t(statement, clause, ordinal, value)")
def sql_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of some statements."""
    return sqlprofile.clauses(spark, (*STATEMENTS, ("q9", "SELECT a, row_number() OVER (PARTITION BY b ORDER BY c) AS r FROM t LIMIT 5")))


_MAPPED = (("s1", "<include refid='cols'/> FROM t <if test='x'>WHERE k = #{k}</if>"), ("s2", "SELECT <include refid='nowhere'/> FROM t"), ("s3", "SELECT <include refid='ring'/>"), ("s4", "SELECT a FROM t"), ("s5", "SELECT FROM ("), ("s6", "DROP TABLE t"))
_FRAGMENTS = {"cols": "SELECT a, <include refid='more'/>", "more": "b", "ring": "x <include refid='ring2'/>", "ring2": "<include refid='ring'/>"}


@query("SELECT * FROM (VALUES ('s1', 'PARTIAL', 'DYNAMIC_TAGS', 'SELECT'), ('s2', 'UNSUPPORTED', 'INCLUDE_UNRESOLVED', 'SELECT'), ('s3', 'UNSUPPORTED', 'INCLUDE_CYCLE', 'SELECT'), ('s4', 'PARSED', '', 'SELECT'), ('s5', 'UNSUPPORTED', 'SYNTAX', 'SELECT'), ('s6', 'PARTIAL', 'NOT_DML', 'OTHER')) t(statement, status, reasons, operation)")
def sql_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far mapper statements can be read once their fragments are in place, and why no further."""
    return sqlprofile.statuses(spark, _MAPPED, _FRAGMENTS)
