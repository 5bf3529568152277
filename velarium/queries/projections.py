"""Model documents as catalog tables, targets and look-ups, flow graphs, and paging through cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions import scalar as S
from velarium.operators import flows, joins, paging
from velarium.operators import projection as P
from velarium.registry import query
from velarium.session import table

_TYPES = "CASE p_partkey % 6 WHEN 0 THEN 'ID' WHEN 1 THEN 'FOREIGN_KEY' WHEN 2 THEN 'AMOUNT' WHEN 3 THEN 'DATETIME' WHEN 4 THEN 'ENUM' ELSE 'TEXT' END"
_ROLES = "CASE p_partkey % 6 WHEN 0 THEN 'PRIMARY_KEY' WHEN 1 THEN 'JOIN_KEY' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'MEASURE' ELSE 'DIMENSION' END WHEN 3 THEN 'TIME' WHEN 4 THEN 'DIMENSION' ELSE 'TEXT' END"


def documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A document for each part, as JSON, projected."""
    key = "p_partkey"
    field = "named_struct('id', concat('f', p_partkey % {n}), 'type', {t}, 'is_metric', p_size % 2 = 0)"
    tables = f"array(named_struct('id', 'a', 'kind', CASE WHEN p_partkey % 2 = 0 THEN 'EVENT' ELSE 'ENTITY' END, 'evidence', CASE WHEN p_partkey % 10 = 0 THEN array() ELSE array('e') END, 'fields', array({field.format(n=6, t=_TYPES)}, {field.format(n=3, t=repr('TEXT'))})), named_struct('id', 'b', 'kind', 'ENTITY', 'evidence', array('e'), 'fields', array({field.format(n=6, t=_TYPES)})))"
    relations = "array(named_struct('id', 'r', 'source', 'a', 'target', CASE WHEN p_partkey % 7 = 0 THEN 'c' ELSE 'b' END, 'evidence', array('e')))"
    metrics = "array(named_struct('id', 'm', 'event', 'a', 'aggregation', CASE WHEN p_partkey % 3 = 0 THEN 'SUM' ELSE 'max' END, 'formula', CASE WHEN p_partkey % 9 = 0 THEN 'SUM(x - y)' ELSE 'sum( amount )' END, 'fields', array(concat('f', p_partkey % 4)), 'evidence', CASE WHEN p_partkey % 15 = 0 THEN array() ELSE array('e') END))"
    return P.catalog_tables(table(spark, sf_dir, "part").selectExpr(key, f"to_json(named_struct('tables', {tables}, 'relations', {relations}, 'metrics', {metrics})) AS payload"), key, "payload")


@query(f"SELECT p_partkey, object, ordinal, field, type, role FROM (SELECT p_partkey, 'a' AS object, 0 AS ordinal, 'f' || p_partkey % 6 AS field, {_TYPES} AS type, {_ROLES} AS role FROM part UNION ALL SELECT p_partkey, 'a', 1, 'f' || p_partkey % 3, 'TEXT', 'TEXT' FROM part UNION ALL SELECT p_partkey, 'b', 0, 'f' || p_partkey % 6, {_TYPES}, {_ROLES} FROM part)")
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of model documents with the roles that their types have."""
    return documents(spark, sf_dir)["fields"]


@query("SELECT p_partkey, 'r' AS relation, 'a' AS source, CASE WHEN p_partkey % 7 = 0 THEN 'c' ELSE 'b' END AS target, CASE WHEN p_partkey % 7 = 0 THEN 'EVENT_EVENT' WHEN p_partkey % 2 = 0 THEN 'EVENT_ENTITY' ELSE 'ENTITY_ENTITY' END AS type, p_partkey % 7 <> 0 AS resolved, 1 AS n_evidence FROM part")
def project_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)["relations"]


@query("SELECT p_partkey, 'm' AS metric, p_partkey % 3 = 0 AND p_partkey % 9 <> 0 AS editable FROM part")
def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)["metrics"].select("p_partkey", "metric", "editable")


@query("SELECT p_partkey, 'RELATION_ENDPOINTS' AS check, 1::BIGINT AS n FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'FIELD_UNIQUENESS', 1 FROM part WHERE p_partkey % 6 = p_partkey % 3 UNION ALL SELECT p_partkey, 'METRIC_DEPENDENCIES', 1 FROM part WHERE p_partkey % 4 NOT IN (p_partkey % 6, p_partkey % 3) UNION ALL SELECT p_partkey, 'SOURCE_EVIDENCE', CASE WHEN p_partkey % 30 = 0 THEN 2 ELSE 1 END FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 15 = 0")
def gov_publication_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four checks of a model document before it may be published."""
    return P.publication_checks(documents(spark, sf_dir), "p_partkey")


_RULED = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'm' ELSE 'x' END || s_suppkey AS target, CASE WHEN s_suppkey % 4 = 0 THEN 'o' || s_suppkey END AS owner FROM supplier"


@query(f"WITH r AS ({_RULED}), m AS (SELECT 'm' || s_suppkey AS code, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0), v AS (SELECT 'o' || s_suppkey AS code, s_name AS name FROM supplier WHERE s_suppkey % 8 = 0), n AS (SELECT 'x' || s_suppkey AS code, s_name AS name FROM supplier WHERE s_suppkey % 5 = 0) SELECT r.id, CASE WHEN m.code IS NOT NULL THEN 'METRIC' WHEN v.code IS NOT NULL THEN 'EVENT' WHEN n.code IS NOT NULL THEN 'ENTITY' END AS target_type, coalesce(m.name, v.name, n.name) AS name, CASE WHEN coalesce(m.code, v.code, n.code) IS NULL THEN 'UNRESOLVED_TARGET' ELSE 'NEEDS_STRUCTURE' END AS status FROM r LEFT JOIN m ON m.code = r.target LEFT JOIN v ON v.code = coalesce(r.owner, r.target) LEFT JOIN n ON n.code = coalesce(r.owner, r.target)")
def rule_candidate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    coded = lambda letter, n: supplier.where(f"s_suppkey % {n} = 0").selectExpr(f"concat('{letter}', s_suppkey) AS code", "s_name AS name")
    rules = supplier.selectExpr("s_suppkey AS id", "concat(CASE WHEN s_suppkey % 3 = 0 THEN 'm' ELSE 'x' END, s_suppkey) AS target", "CASE WHEN s_suppkey % 4 = 0 THEN concat('o', s_suppkey) END AS owner")
    return P.resolve_targets(rules, coded("m", 2), coded("o", 8), coded("x", 5))


@query("WITH q AS (SELECT c_custkey AS id, lower(concat('which ', c_mktsegment, ' has ', CASE c_custkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' ELSE 'nothing' END)) AS text FROM customer), w AS (SELECT DISTINCT id, unnest(string_split(text, ' ')) AS word FROM q), t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, p_partkey AS rule, p_size AS priority FROM part), a AS (SELECT DISTINCT lower(c_mktsegment) AS word, c_nationkey AS object, c_nationkey % 7 AS priority FROM customer) SELECT q.id, (SELECT min_by(rule, (priority, rule)) FROM w JOIN t USING (word) WHERE w.id = q.id) AS rule, (SELECT min_by(object, (priority, object)) FROM w JOIN a USING (word) WHERE w.id = q.id) AS object FROM q")
def rule_question_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to the rule and the object that their words name. Rules of a word are reduced to the first one before the join."""
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    word = F.when(F.col("c_custkey") % 3 == 0, "ring").when(F.col("c_custkey") % 3 == 1, "bolt").otherwise("nothing")
    questions = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Which "), "c_mktsegment", F.lit(" has "), word, F.lit("?")).alias("text"))
    first = lambda df, name: df.groupBy("word").agg(F.min(F.struct("priority", name)).alias("m")).select("word", "m.*")
    triggers = first(part.select(F.explode(F.split("p_name", " ")).alias("word"), F.col("p_partkey").alias("rule"), F.col("p_size").alias("priority")), "rule")
    aliases = first(customer.select(F.lower("c_mktsegment").alias("word"), F.col("c_nationkey").alias("object"), (F.col("c_nationkey") % 7).alias("priority")), "object")
    return P.look_up(questions, triggers, aliases)


@query("WITH RECURSIVE f AS (SELECT s_suppkey AS metric, s_suppkey // 2 AS ref FROM supplier WHERE s_suppkey > 1 AND s_suppkey % 4 <> 1), w(id, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION ALL SELECT w.id, f.ref FROM w JOIN f ON f.metric = w.node) SELECT s_suppkey AS id, (SELECT min('e' || node) FROM w WHERE w.id = s_suppkey AND node % 4 = 1) AS event FROM supplier")
def graph_metric_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that each metric's formula goes back to."""
    supplier = table(spark, sf_dir, "supplier")
    metrics = supplier.selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 4 = 1 THEN concat('e', s_suppkey) END AS event")
    refs = supplier.where("s_suppkey > 1").selectExpr("s_suppkey AS metric", "0 AS position", "s_suppkey div 2 AS ref").union(supplier.selectExpr("s_suppkey", "1", "s_suppkey + 1"))
    return P.root_events(metrics, refs.where("position = 0"))


@query("SELECT r_name || '/' || n_name AS path, row_number() OVER (ORDER BY r_name, n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def hier_sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members in the order of the tree, siblings by name."""
    from velarium.operators.ranking import places

    members = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return places(members, ["r_name", "n_name"]).select(F.concat_ws("/", "r_name", "n_name").alias("path"), "place")


_STATEMENTS = (
    "SELECT user_id AS method, event_id AS id, CASE WHEN event_type = 'view' THEN 'BRANCH' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'RETURN' WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'CALL' ELSE 'PLAIN' END AS kind,"
    " CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 4 = 2 THEN lag(event_id, 3) OVER m ELSE lead(event_id, 5) OVER m END END AS target, concat('v', event_id % 3) AS variable, event_id % 5 = 0 AS defines,"
    " CASE WHEN event_id % 10 = 0 THEN concat('v', (event_id + 1) % 3) END AS source, CASE WHEN event_type = 'signup' AND event_id % 4 = 1 THEN user_id + 1 END AS callee FROM events WINDOW m AS (PARTITION BY user_id ORDER BY event_id)"
)
_FLOW = "SELECT method, id AS a, b, kind FROM (SELECT method, id, lead(id) OVER (PARTITION BY method ORDER BY id) AS b, CASE kind WHEN 'BRANCH' THEN 'TRUE' ELSE 'NEXT' END AS kind, kind AS was FROM s) WHERE b IS NOT NULL AND was <> 'RETURN' UNION ALL SELECT method, id, target, 'FALSE' FROM s WHERE kind = 'BRANCH' AND target IS NOT NULL"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of methods, made from events of users: branches ahead and back, calls, returns, definitions and assignments."""
    table(spark, sf_dir, "events").createOrReplaceTempView("__statement_events")
    return spark.sql(_STATEMENTS.replace("FROM events", "FROM __statement_events"))


@query(f"WITH s AS ({_STATEMENTS}) {_FLOW}")
def flow_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.control_flow(statements(spark, sf_dir))


@query(f"""
    WITH s AS ({_STATEMENTS}), r AS (SELECT method, id, kind, callee, lead(id) OVER (PARTITION BY method ORDER BY id) AS after FROM s), c AS (SELECT * FROM r WHERE kind = 'CALL')
    SELECT c.method, c.id AS a, c.callee, (SELECT min(id) FROM s WHERE s.method = c.callee) AS b, 'CALL' AS kind FROM c WHERE callee IN (SELECT method FROM s)
    UNION ALL SELECT c.method, x.id, c.callee, c.after, 'RETURN' FROM c JOIN r x ON x.method = c.callee AND (x.kind = 'RETURN' OR x.after IS NULL) WHERE c.after IS NOT NULL
""")
def flow_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between methods: into each called one, and back from each way out of it."""
    return flows.call_edges(statements(spark, sf_dir))


@query(f"""
    WITH RECURSIVE s AS ({_STATEMENTS}), e AS (SELECT DISTINCT method, a, b FROM ({_FLOW})), k AS (SELECT method, id, variable FROM s WHERE defines),
    r(method, variable, a, node) AS (
        SELECT k.method, k.variable, k.id, e.b FROM k JOIN e ON e.method = k.method AND e.a = k.id
        UNION SELECT r.method, r.variable, r.a, e.b FROM r JOIN e ON e.method = r.method AND e.a = r.node WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.method = r.method AND k.id = r.node AND k.variable = r.variable)
    ), u AS (SELECT method, id, variable, 'DEF_USE' AS kind FROM s WHERE NOT defines UNION ALL SELECT method, id, source, 'ASSIGNMENT' FROM s WHERE defines AND source IS NOT NULL)
    SELECT u.method, u.variable, r.a, u.id AS b, u.kind FROM u JOIN r ON r.method = u.method AND r.variable = u.variable AND r.node = u.id
    UNION ALL SELECT method, variable, id, (SELECT min(id) FROM s x WHERE x.method = s.callee), 'ARGUMENT_TO_PARAMETER' FROM s WHERE kind = 'CALL' AND NOT defines AND callee IN (SELECT method FROM s)
""")
def flow_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that reach uses over branches and loops, assignments and arguments."""
    rows = statements(spark, sf_dir)
    return flows.data_flow(rows, flows.control_flow(rows))


@query(f"WITH s AS ({_STATEMENTS}), e AS (SELECT DISTINCT method, a, b FROM ({_FLOW})), d AS (SELECT method, node, sum(o) AS o, sum(i) AS i FROM (SELECT method, a AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT method, b, 0, 1 FROM e) GROUP BY 1, 2) SELECT method, node, CASE WHEN o > 1 AND i > 1 THEN 'BOTH' WHEN o > 1 THEN 'BRANCH' WHEN i > 1 THEN 'JOIN' WHEN i = 0 THEN 'START' WHEN o = 0 THEN 'END' ELSE 'LINEAR' END AS disposition FROM d")
def flow_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.dispositions(flows.control_flow(statements(spark, sf_dir)))


@query("WITH c AS (SELECT DISTINCT o_custkey AS caller, o_custkey * 2 % 101 AS callee FROM orders), n AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT caller AS node, 1 AS o, 0 AS i FROM c UNION ALL SELECT callee, 0, 1 FROM c) GROUP BY 1) SELECT *, CASE WHEN n_in = 0 THEN 'ENTRY' WHEN n_out = 0 THEN 'LEAF' ELSE 'INNER' END AS role FROM n")
def flow_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.call_graph(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller"), (F.col("o_custkey") * 2 % 101).alias("callee")))


@query("SELECT c_custkey, 'PENDING' AS side FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'STRAY' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def flow_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a work list has left open, or got from nowhere."""
    return flows.unsettled(table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


SECRET = b"test"


_RANKED = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS customer FROM orders"


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with keys that may be NULL."""
    when = lambda n, c: F.when(F.col("o_orderkey") % n > 0, F.col(c))
    return table(spark, sf_dir, "orders").select("o_orderkey", when(5, "o_orderpriority").alias("priority"), when(3, "o_custkey").alias("customer"))


@query(f"WITH r AS ({_RANKED}), n AS (SELECT count(*) AS total, (count(*) + 19) // 20 * 2 // 3 AS page FROM r) SELECT o_orderkey, priority, customer, page, total FROM (SELECT *, row_number() OVER (ORDER BY priority NULLS LAST, customer NULLS LAST, o_orderkey) AS k FROM r), n WHERE k > (page - 1) * 20 AND k <= page * 20")
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page at two thirds of all, by an index of ranges: it reads no more than the first page does."""
    index = paging.PageIndex.build(ranked_orders(spark, sf_dir), ["priority", "customer", "o_orderkey"], nulls_last=True)
    number = index.pages(20) * 2 // 3
    return index.page(number, 20).withColumn("page", F.lit(number).cast("long")).withColumn("total", F.lit(index.total).cast("long"))


@query(f"WITH r AS ({_RANKED}) SELECT o_orderkey, priority, customer FROM r WHERE priority IS NULL AND customer IS NULL OR priority IS NULL AND customer = (SELECT min(customer) FROM r WHERE priority IS NULL) ORDER BY priority NULLS FIRST, customer NULLS FIRST, o_orderkey LIMIT 50 OFFSET (SELECT greatest(count(*) - 45, 0) FROM r WHERE priority IS NULL AND customer IS NULL)")
def page_over_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after one whose keys are NULL: first the rest of these, then those of the first customer."""
    rows, keys = ranked_orders(spark, sf_dir), ["priority", "customer", "o_orderkey"]
    both = rows.where("priority IS NULL AND customer IS NULL")
    at = both.orderBy(F.desc("o_orderkey")).offset(45).limit(1).select("o_orderkey").head()
    first = rows.where("priority IS NULL").agg(F.min("customer")).first()[0]
    page = paging.keyset(rows, keys, 50, after=(None, None, at[0]) if at else None)
    return page.where(F.col("customer").isNull() | (F.col("customer") == first))


@query("SELECT c_custkey, c_name, 3 AS page, true AS has_more, (SELECT count(*) FROM customer) AS total FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40)")
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, by the cursors of the two before; the index is made once."""
    index, cursor = paging.PageIndex.build(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]), None
    for number in range(1, 4):
        page = index.read(SECRET, {"run": "r1", "filter": ""}, size=20, cursor=cursor)
        cursor = page.after
    return page.rows.select("c_custkey", "c_name", F.lit(number).alias("page"), F.lit(page.has_more).alias("has_more"), F.lit(page.total).cast("long").alias("total"))


@query("SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS total, (SELECT count(*) > 60 FROM part WHERE p_size % 2 = 0) AS has_more FROM (SELECT p_partkey FROM part WHERE p_size % 2 = 0 ORDER BY p_partkey LIMIT 20 OFFSET 40)")
def page_digest_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a filtered list by cursors that name the filter's digest and an offset."""
    rows, asked, cursor = table(spark, sf_dir, "part").where("p_size % 2 = 0").select("p_partkey"), {"q": "", "sizes": ["even"]}, None
    for _ in range(3):
        page = paging.offset_page(rows, ["p_partkey"], asked, first=20, after=cursor)
        cursor = page.after
    return page.rows.withColumn("total", F.lit(page.total).cast("long")).withColumn("has_more", F.lit(page.has_more))


@query("SELECT * FROM (VALUES (0::BIGINT, 0, 2166136261), (1, 3904355907, 3826002220), (2, 891568578, 440920331), (3, 3421780262, 3146166556)) t(id, crc, fnv)")
def fn_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 and FNV-1a of known texts, against their published values."""
    known = spark.createDataFrame([(0, ""), (1, "a"), (2, "abc"), (3, "123456789")], "id long, text string")
    return known.select("id", S.crc_32(F.col("text")).alias("crc"), S.fnv1a_32(F.col("text")).alias("fnv"))


@query("SELECT event_id, '{\"a_user\":' || user_id || ',\"kind\":\"' || event_type || '\",\"note\":null,\"z\":' || event_id || '}' AS body FROM events")
def fn_sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: keys in order, nulls kept."""
    return table(spark, sf_dir, "events").select("event_id", S.sorted_json({"z": F.col("event_id"), "kind": F.col("event_type"), "a_user": F.col("user_id"), "note": F.lit(None).cast("string")}).alias("body"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ing') AND p_partkey % 2 = 0")
def filter_alias_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that hold a text as it is written, confirmed ones only."""
    return table(spark, sf_dir, "part").where(F.col("p_name").contains("ing") & (F.col("p_partkey") % 2 == 0)).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, string_agg(lower(l_returnflag || l_linestatus), ' ') AS text FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND left(o_orderpriority, 1) IN ('1', '2') AND contains(lower(o_orderpriority) || ' ' || text, 'rf')")
def filter_issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several statuses and severities, and a text that the issue or one of its claims holds. A claim is searched by itself, so none are collected."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O') AND left(o_orderpriority, 1) IN ('1', '2')")
    hits = table(spark, sf_dir, "lineitem").where(F.lower(F.concat("l_returnflag", "l_linestatus")).contains("rf")).select(F.col("l_orderkey").alias("o_orderkey"))
    own = orders.where(F.lower("o_orderpriority").contains("rf")).select("o_orderkey")
    with_lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(hits.union(own.join(with_lines, "o_orderkey", "left_semi")), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT n_nationkey, n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_suppkey % 5 = 0")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0")
    return supplier.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT key, c_custkey, s_suppkey FROM (SELECT c_nationkey AS key, c_custkey FROM customer) JOIN (SELECT s_nationkey AS key, s_suppkey FROM supplier) USING (key)")
def join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")
    return joins.many_to_many(left, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey"), "key")


@query("WITH v AS (SELECT p_partkey, 1 AS version, p_size AS value FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey, CASE WHEN a.version IS NULL THEN 'ADDED' WHEN b.version IS NULL THEN 'REMOVED' WHEN a.value = b.value THEN 'INHERITED' ELSE 'MODIFIED' END AS change FROM (SELECT * FROM v WHERE version = 1) a FULL JOIN (SELECT * FROM v WHERE version = 2) b USING (p_partkey)")
def win_version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each object from one version to the next: one aggregate by key, no join."""
    part = table(spark, sf_dir, "part")
    versions = part.where("p_partkey % 3 <> 0").selectExpr("p_partkey", "1 AS version", "p_size AS value").union(part.where("p_partkey % 5 <> 0").selectExpr("p_partkey", "2", "CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END"))
    side = lambda n: F.max(F.when(F.col("version") == n, F.col("value")))
    both = versions.groupBy("p_partkey").agg(side(1).alias("a"), side(2).alias("b"))
    return both.select("p_partkey", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "INHERITED").otherwise("MODIFIED").alias("change"))


@query("SELECT l_returnflag AS kind, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_linestatus = 'F') AS done, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1")
def review_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of a review, how many changes of each state."""
    status = lambda s: F.count_if(F.col("l_linestatus") == s)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(status("O").alias("open"), status("F").alias("done"), F.count_distinct("l_suppkey").alias("owners"))


@query("SELECT p_brand, count(*) FILTER (p_size <= 5) AS stock_out, count(*) FILTER (p_size BETWEEN 6 AND 20) AS low, round(sum(CASE WHEN p_size > 5 THEN p_retailprice END), 2) AS worth FROM part GROUP BY 1")
def rule_stock_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock at or below nothing (here five) counts as out and is worth nothing."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(size <= 5).alias("stock_out"), F.count_if(size.between(6, 20)).alias("low"), F.round(F.sum(F.when(size > 5, F.col("p_retailprice"))), 2).alias("worth"))


@query("SELECT event_type, count(*) AS redeemed FROM events JOIN (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'signup' GROUP BY 1) s USING (user_id) WHERE ts BETWEEN first AND first + INTERVAL 7 DAY AND event_type <> 'signup' GROUP BY 1")
def rule_redemption_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redemptions count within the validity that began for the user."""
    events = table(spark, sf_dir, "events")
    begun = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first"))
    valid = events.where("event_type <> 'signup'").join(begun, "user_id").where("ts >= first AND ts <= first + INTERVAL 7 DAYS")
    return valid.groupBy("event_type").agg(F.count(F.lit(1)).alias("redeemed"))


@query("WITH h AS (SELECT n_nationkey AS id, n_regionkey AS holiday, 2000 + n_nationkey % 3 AS year, n_nationkey AS first_day, n_nationkey + CASE WHEN n_nationkey % 6 = 0 THEN -1 ELSE 2 END AS last_day FROM nation) SELECT 'HOLIDAY_ENDS_BEFORE_IT_BEGINS' AS code, CAST(id AS VARCHAR) AS key FROM h WHERE last_day < first_day UNION ALL SELECT 'HOLIDAY_TWICE_A_YEAR', holiday || '/' || year FROM h GROUP BY holiday, year HAVING count(*) > 1")
def dq_holiday_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A holiday's period ends no earlier than it begins, and there is one a year."""
    h = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_regionkey AS holiday", "2000 + n_nationkey % 3 AS year", "n_nationkey AS first_day", "n_nationkey + CASE WHEN n_nationkey % 6 = 0 THEN -1 ELSE 2 END AS last_day")
    late = h.where("last_day < first_day").selectExpr("'HOLIDAY_ENDS_BEFORE_IT_BEGINS' AS code", "CAST(id AS STRING) AS key")
    twice = h.groupBy(F.concat_ws("/", "holiday", "year").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").selectExpr("'HOLIDAY_TWICE_A_YEAR' AS code", "key")
    return late.unionByName(twice)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name COLLATE nocase, p_partkey) AS place FROM part QUALIFY place <= 50")
def sort_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order by a locale's rules (`UNICODE_CI`; `zh` and others by name) in place of bytes."""
    return paging.numbered(table(spark, sf_dir, "part").select("p_partkey", F.collate("p_name", "UNICODE_CI").alias("n")), [F.col("n").asc(), F.col("p_partkey").asc()], 50).select("p_partkey", F.col("place").cast("long").alias("place"))
