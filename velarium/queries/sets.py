"""Set operations and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import joins as J
from velarium.operators.linediff import line_diff as diff_lines
from velarium.queries.joins import _VERSIONS, part_versions
from velarium.registry import query
from velarium.session import table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey % 3 <> 0"


@query(f"{_A} UNION {_B}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query("SELECT n_regionkey, list_sort(list(DISTINCT n_nationkey)) = list_sort(list(DISTINCT CASE WHEN n_nationkey % 24 = 0 THEN n_nationkey + 1 ELSE n_nationkey END)) AS same FROM nation GROUP BY 1")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("n_nationkey") % 24 == 0, F.col("n_nationkey") + 1).otherwise(F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg((F.array_sort(F.collect_set("n_nationkey")) == F.array_sort(F.collect_set(other))).alias("same"))


@query("SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def set_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct by a key where the first in order wins."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def set_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {_VERSIONS} SELECT b.p_partkey, 'p_size' AS field, CAST(b.p_size AS VARCHAR) AS before, CAST(n.p_size AS VARCHAR) AS after FROM base b JOIN nxt n USING (p_partkey) WHERE b.p_size IS DISTINCT FROM n.p_size")
def diff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.diff_fields(*part_versions(spark, sf_dir), "p_partkey")


_JSON = "SELECT p_partkey, map {'name': p_name, 'spec.size': CAST(p_size AS VARCHAR), 'spec.brand': p_brand} AS m FROM part"


@query(f"WITH o AS (SELECT p_partkey, unnest(map_entries(m)) AS e FROM ({_JSON})), n AS (SELECT p_partkey, e.key AS path, CASE WHEN e.key = 'spec.size' AND p_partkey % 4 = 0 THEN '99' ELSE e.value END AS value FROM o WHERE NOT (e.key = 'spec.brand' AND p_partkey % 9 = 0)), b AS (SELECT p_partkey, e.key AS path, e.value AS value FROM o) SELECT p_partkey, path, b.value AS before, n.value AS after FROM b FULL JOIN n USING (p_partkey, path) WHERE b.value IS DISTINCT FROM n.value")
def diff_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents flattened to (path, value), and compared path by path."""
    part = table(spark, sf_dir, "part")
    spec = lambda size, brand: F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(size.alias("size"), brand.alias("brand")).alias("spec")))
    changed = spec(F.when(F.col("p_partkey") % 4 == 0, 99).otherwise(F.col("p_size")), F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")))

    def paths(doc):
        entries = F.array(*[F.struct(F.lit(path).alias("path"), F.get_json_object(doc, f"$.{path}").alias("value")) for path in ("name", "spec.size", "spec.brand")])
        return part.select("p_partkey", F.explode(entries).alias("e")).select("p_partkey", "e.*").where("value IS NOT NULL")

    before, after = paths(spec(F.col("p_size"), F.col("p_brand"))).withColumnRenamed("value", "before"), paths(changed).withColumnRenamed("value", "after")
    return before.join(after, ["p_partkey", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, and what is left of it without every fifth line, with a new line after every seventh."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("before"))
    lines = F.transform(F.split("before", "\n", -1), lambda line, k: F.struct(line.alias("line"), k.alias("k")))
    kept = F.filter(lines, lambda x: x["k"] % 5 != 2)
    more = F.flatten(F.transform(kept, lambda x: F.when(x["k"] % 7 == 3, F.array(x["line"], F.concat(F.lit("new line "), x["k"].cast("string")))).otherwise(F.array(x["line"]))))
    return docs.withColumn("after", F.array_join(more, "\n"))


@query()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against its edited version: lines kept, removed and added."""
    return diff_lines(edited_documents(spark, sf_dir), "id", "before", "after")


@query("""
    WITH l AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents)
    SELECT id, count(*) FILTER (k % 5 <> 2) AS n_unchanged, count(*) FILTER (k % 5 = 2) AS n_removed, count(*) FILTER (k % 5 <> 2 AND k % 7 = 3) AS n_added,
        md5(string_agg(line, chr(10) ORDER BY k)) AS before, md5(string_agg(line || CASE WHEN k % 7 = 3 THEN chr(10) || 'new line ' || k ELSE '' END, chr(10) ORDER BY k) FILTER (k % 5 <> 2)) AS after
    FROM l GROUP BY id
""")
def line_diff_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the differences alone: how many lines are common (as many as can be), and both texts, rebuilt."""
    rows = diff_lines(edited_documents(spark, sf_dir), "id", "before", "after")
    of = lambda change: F.count(F.when(F.col("change") == change, 1))
    text = lambda change: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("change") != change, F.struct("line_number", "line")))), lambda x: x["line"]), "\n").cast("binary"))
    return rows.groupBy("id").agg(of("UNCHANGED").alias("n_unchanged"), of("REMOVED").alias("n_removed"), of("ADDED").alias("n_added"), text("ADDED").alias("before"), text("REMOVED").alias("after"))


_LINED = ((1, "a\nb\nc", "a\nx\nc"), (2, "", "new"), (3, "same", "same"), (4, "a\nb\nc\nd", "b\nd\ne"), (5, None, None), (6, "x\nx\ny", "x\ny\ny"))
_LINES = (
    (1, 0, "UNCHANGED", "a"), (1, 1, "REMOVED", "b"), (1, 2, "ADDED", "x"), (1, 3, "UNCHANGED", "c"), (2, 0, "REMOVED", ""), (2, 1, "ADDED", "new"), (3, 0, "UNCHANGED", "same"),
    (4, 0, "REMOVED", "a"), (4, 1, "UNCHANGED", "b"), (4, 2, "REMOVED", "c"), (4, 3, "UNCHANGED", "d"), (4, 4, "ADDED", "e"), (5, 0, "UNCHANGED", ""), (6, 0, "UNCHANGED", "x"), (6, 1, "REMOVED", "x"), (6, 2, "UNCHANGED", "y"), (6, 3, "ADDED", "y"),
)


@query("SELECT * FROM (VALUES " + ", ".join(map(str, _LINES)) + ") t(id, line_number, change, line)")
def line_diff_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small texts whose differences were written down by hand."""
    return diff_lines(spark.createDataFrame(list(_LINED), "id int, before string, after string"), "id", "before", "after")
