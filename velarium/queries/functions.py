"""Scalar functions, projections and null handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions import scalar as S
from velarium.registry import query
from velarium.session import table


@query(r"SELECT p_partkey, upper(trim(p_name)) AS u, lower(p_brand) AS l, contains(p_type, 'S') AS c, starts_with(p_name, 'Part') AS s, replace(p_name, '#', '-') AS r, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, substr(p_name, 1, 3) AS sub, concat_ws('/', p_brand, p_type) AS joined, strlen(p_name) AS bytes, regexp_matches(p_name, '[0-9]+$') AS digits FROM part")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("u"), F.lower("p_brand").alias("l"), F.col("p_type").contains("S").alias("c"), F.col("p_name").startswith("Part").alias("s"), F.replace("p_name", F.lit("#"), F.lit("-")).alias("r"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.substring("p_name", 1, 3).alias("sub"), F.concat_ws("/", "p_brand", "p_type").alias("joined"), F.octet_length("p_name").cast("long").alias("bytes"), F.col("p_name").rlike("[0-9]+$").alias("digits"),
    )


@query(r"SELECT page_id, url_decode(replace(list_filter(regexp_split_to_array(url, '[/#:]'), lambda x: x <> '')[-1], '+', '%2B')) AS name, url_encode(url) AS encoded, url_decode(url_encode(url)) = url AS back, '/' || trim(regexp_replace(split_part(url, '://', 2), '/+', '/', 'g'), '/') AS route FROM pages")
def fn_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = F.regexp_replace(F.regexp_replace(F.url_encode("url"), "\\+", "%20"), "%7E", "~")
    rest = F.element_at(F.split("url", "://"), 2)
    return table(spark, sf_dir, "pages").select("page_id", S.local_name(F.col("url")).alias("name"), encoded.alias("encoded"), (F.url_decode(F.url_encode("url")) == F.col("url")).alias("back"), S.compose_route(F.lit(None).cast("string"), rest).alias("route"))


@query("SELECT c_custkey, sha256(c_name) AS sha, md5(c_name) AS m, rtrim(replace(replace(base64(encode(c_name)), '+', '-'), '/', '_'), '=') AS b FROM customer")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha"), F.md5("c_name").alias("m"), S.base64url(F.col("c_name")).alias("b"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS canonical FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("valid"), F.to_json(F.struct("event_type", "user_id")).alias("canonical"))


_TAGS = "string_split(lower(p_name), ' ')"


@query(f"SELECT p_partkey, len({_TAGS}) AS n, list_sort(list_distinct({_TAGS}))[1] AS first, {_TAGS}[-1] AS last, list_has_any({_TAGS}, ['ring', 'bolt']) AS metal, array_to_string(list_sort(list_distinct({_TAGS} || [lower(p_brand)])), '|') AS merged, list_sum(range(1, p_size + 1))::BIGINT AS total FROM part")
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.split(F.lower("p_name"), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(tags).cast("long").alias("n"), F.element_at(F.array_sort(F.array_distinct(tags)), 1).alias("first"), F.element_at(tags, -1).alias("last"), F.arrays_overlap(tags, F.array(F.lit("ring"), F.lit("bolt"))).alias("metal"),
        F.array_join(F.array_sort(F.array_union(tags, F.array(F.lower("p_brand")))), "|").alias("merged"), F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


@query("SELECT p_partkey, k, v FROM (SELECT p_partkey, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT p_partkey, map {'brand': p_brand, 'type': p_type, 'size': CAST(p_size AS VARCHAR)} AS m FROM part)) WHERE k <> 'type'")
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps merged, an entry deleted, and the rest as rows."""
    both = F.map_concat(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.map_filter(both, lambda k, v: k != "type")).alias("k", "v"))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, ceil(o_totalprice / 1000)::BIGINT AS up, floor(o_totalprice / 1000)::BIGINT AS down, least(greatest(o_totalprice, 50000), 200000) AS clamped, o_totalprice / nullif(o_orderkey % 3, 0) AS ratio, coalesce(nullif(o_orderkey % 2, 0), -1) AS filled, isfinite(o_totalprice) AS finite, o_totalprice / 500000 >= 0.95 AS adopted FROM orders")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(price * 100).cast("long").alias("cents"), F.ceil(price / 1000).cast("long").alias("up"), F.floor(price / 1000).cast("long").alias("down"), F.least(F.greatest(price, F.lit(50000.0)), F.lit(200000.0)).alias("clamped"),
        (price / F.nullif(key % 3, F.lit(0))).alias("ratio"), F.coalesce(F.nullif(key % 2, F.lit(0)), F.lit(-1)).alias("filled"), (~F.isnan(price) & price.isNotNull()).alias("finite"), (price / 500000 >= 0.95).alias("adopted"),
    )


@query("SELECT s_suppkey, regexp_replace('SELECT #{id} FROM ${t} WHERE s = #{name}', '#\\{[^}]*\\}', '?', 'g') AS bound, s_name || '样本' AS label, true AS cjk, lower(regexp_replace('orderLineNo' || s_suppkey, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM supplier")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("s_name", F.lit("样本"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.bind_tokens(F.lit("SELECT #{id} FROM ${t} WHERE s = #{name}")).alias("bound"), label.alias("label"), S.has_cjk(label).alias("cjk"), S.snake_case(F.concat(F.lit("orderLineNo"), "s_suppkey")).alias("snake"))


@query("WITH x AS (SELECT s_suppkey, concat('<s><name>', s_name, '</name>', CASE WHEN s_suppkey % 4 <> 0 THEN concat('<balance>', s_suppkey, '</balance>') ELSE '' END, '<alias>a</alias><alias>b</alias></s>') AS xml FROM supplier) SELECT s_suppkey, regexp_extract(xml, '<name>(.*?)</name>', 1) AS name, contains(xml, '<balance>') AS has_balance, len(regexp_extract_all(xml, '<alias>'))::BIGINT AS n_aliases FROM x")
def fn_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read from XML text."""
    balance = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("<balance>"), F.col("s_suppkey").cast("string"), F.lit("</balance>"))).otherwise("")
    xml = F.concat(F.lit("<s><name>"), "s_name", F.lit("</name>"), balance, F.lit("<alias>a</alias><alias>b</alias></s>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.xpath_string(xml, F.lit("s/name")).alias("name"), F.xpath_boolean(xml, F.lit("s/balance")).alias("has_balance"), F.size(F.xpath(xml, F.lit("s/alias/text()"))).cast("long").alias("n_aliases"))


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'DONE' END AS role FROM lineitem")
def project_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field mappings with an expression, and a role by cases."""
    role = F.when(F.col("l_returnflag") == "R", "RETURNED").when(F.col("l_linestatus") == "O", "OPEN").otherwise("DONE")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)"), 6).alias("charge"), role.alias("role"))


@query("SELECT p_partkey, k - 1 AS ordinal, string_split(p_name, ' ')[k] AS word, len(string_split(p_name, ' ')) AS size FROM part, range(1, 6) t(k) WHERE k <= len(string_split(p_name, ' '))")
def project_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(words).cast("long").alias("size"), F.posexplode(words).alias("ordinal", "word")).withColumn("ordinal", F.col("ordinal").cast("long"))
