"""Evidence: records to claims, findings and candidates; reconciliation and integrity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.operators import evidence as E
from velarium.operators import governance as V
from velarium.operators import ranged
from velarium.registry import query
from velarium.session import materialize, table

_REC = "SELECT p_partkey AS id, p_brand AS subject, p_type AS predicate, CAST(p_size % 3 AS VARCHAR) AS value, 'root' || p_partkey % 4 AS root, p_partkey % 5 = 0 AS derived FROM part"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records made from parts: brands are subjects, types predicates, sizes values."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("predicate"), (F.col("p_size") % 3).cast("string").alias("value"),
        F.concat(F.lit("root"), (F.col("p_partkey") % 4).cast("string")).alias("root"), (F.col("p_partkey") % 5 == 0).alias("derived"),
    )


_CLAIMS = "SELECT subject, predicate, value, CASE WHEN bool_and(derived) THEN 'DERIVED_ONLY' WHEN count(DISTINCT CASE WHEN NOT derived THEN root END) > 1 THEN 'MULTI' ELSE 'SINGLE' END AS support, count(*) AS n FROM r GROUP BY 1, 2, 3"
_FINDINGS = "SELECT subject, predicate, count(*) AS n_values, CASE WHEN count(*) > 1 THEN 'CONFLICT' WHEN bool_or(support = 'MULTI') THEN 'CONSISTENT' WHEN bool_or(support = 'SINGLE') THEN 'SINGLE' ELSE 'DERIVED' END AS status FROM c GROUP BY 1, 2"
_WITH = f"WITH r AS ({_REC}), c AS ({_CLAIMS}), f AS ({_FINDINGS})"


@query(f"{_WITH} SELECT * FROM c")
def ev_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.claims(records(spark, sf_dir))


@query(f"WITH r AS ({_REC}) SELECT subject, predicate, value, string_agg(id, ',' ORDER BY id) AS ids, count(DISTINCT root) AS n_roots FROM r GROUP BY 1, 2, 3")
def ev_claim_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.claim_members(records(spark, sf_dir))


@query(f"{_WITH} SELECT * FROM f")
def ev_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.findings(E.claims(records(spark, sf_dir)))


@query(f"{_WITH} SELECT subject, CASE WHEN bool_or(status = 'CONFLICT') THEN 'BLOCKED' WHEN bool_and(status = 'CONSISTENT') THEN 'RECOMMENDED' ELSE 'VERIFY' END AS decision, count(*) FILTER (status = 'CONFLICT') AS n_conflicts FROM f GROUP BY 1")
def ev_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.candidates(E.findings(E.claims(records(spark, sf_dir))))


_KNOWN = "(VALUES ('ECONOMY'), ('PROMO'), ('STANDARD'), ('SMALL'))"


@query(f"WITH r AS ({_REC}) SELECT predicate, count(*) AS n, min(id) AS first_id FROM r WHERE split_part(predicate, ' ', 1) NOT IN (SELECT * FROM {_KNOWN}) GROUP BY 1")
def ev_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates without a mapping, for the queue."""
    known = spark.createDataFrame([("ECONOMY",), ("PROMO",), ("STANDARD",), ("SMALL",)], "word string")
    rows = records(spark, sf_dir).withColumn("word", F.element_at(F.split("predicate", " "), 1))
    return rows.join(known, "word", "left_anti").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"{_WITH} SELECT subject, count(*) FILTER (n_values = 1) AS agreements, count(*) FILTER (n_values > 1) AS issues, CASE WHEN max(n_values) > 2 THEN 'HIGH' WHEN max(n_values) > 1 THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM f GROUP BY 1")
def ev_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.max("n_values")
    severity = F.when(most > 2, "HIGH").when(most > 1, "MEDIUM").otherwise("NONE")
    return E.findings(E.claims(records(spark, sf_dir))).groupBy("subject").agg(F.count_if(F.col("n_values") == 1).alias("agreements"), F.count_if(F.col("n_values") > 1).alias("issues"), severity.alias("severity"))


_CLAIMED = {"id": "p_partkey", "subject": "concat('s', p_partkey % 3)", "predicate": "concat('p', p_partkey % 2)", "value": "concat('v', p_size % 2)", "scope": "concat('c', floor(p_partkey / 6) % 2)", "effective": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('d', floor(p_partkey / 12) % 2) END", "kind": "CASE WHEN p_partkey % 11 = 0 THEN 'GAP' WHEN p_partkey % 7 = 0 THEN 'FROZEN_RECORD' ELSE 'SOURCE' END", "n_refs": "p_partkey % 13"}
_STEPS = (1, 6, 12, 24)


@query(f"""WITH c AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _CLAIMED.items())} FROM part), l AS (SELECT a.id AS left_id, b.id AS right_id FROM c a, c b WHERE b.id - a.id IN {_STEPS})
    SELECT left_id, right_id, CASE WHEN a.n_refs * b.n_refs = 0 OR 'GAP' IN (a.kind, b.kind) THEN 'UNSUPPORTED' WHEN (a.subject, a.predicate) <> (b.subject, b.predicate) THEN 'COMPLEMENTS' WHEN a.scope <> b.scope THEN 'SCOPE_DIFFERENCE'
    WHEN coalesce(a.effective <> b.effective, false) THEN 'TEMPORAL_DRIFT' WHEN a.value <> b.value THEN 'CONFLICTS' WHEN 'FROZEN_RECORD' IN (a.kind, b.kind) THEN 'COMPLEMENTS' ELSE 'CORROBORATES' END AS relation
    FROM l JOIN c a ON a.id = left_id JOIN c b ON b.id = right_id""")
def ev_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What given pairs of claims say of each other."""
    claimed = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in _CLAIMED.items()])
    pairs = claimed.select(F.col("id").alias("left_id"), F.explode(F.array(*[F.col("id") + k for k in _STEPS])).alias("right_id"))
    return E.compare(claimed, pairs)


_STORED = {"id": "CASE WHEN p_partkey % 31 = 0 THEN p_partkey - 1 ELSE p_partkey END", "checksum": "CASE WHEN p_partkey % 23 = 0 THEN 'bad' WHEN p_partkey % 46 = 1 THEN NULL ELSE p_name END", "own": "p_name", "locator": "CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'RDF' ELSE 'ROW' END", "graph": "CASE WHEN p_partkey % 37 = 0 THEN '' ELSE 'g' END", "subject": "p_brand", "predicate": "CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE p_type END"}
_SOURCES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 41 = 0 THEN -p_partkey WHEN p_partkey % 47 = 0 THEN p_partkey ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS source FROM part WHERE p_partkey >= 2"


@query(f"""WITH RECURSIVE r AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _STORED.items())} FROM part), u AS ({_SOURCES}), w(a, b) AS (SELECT id, source FROM u UNION SELECT w.a, u.source FROM w JOIN u ON w.b = u.id)
    SELECT 'DUPLICATE_ID' AS code, id FROM r GROUP BY id HAVING count(*) > 1 UNION SELECT 'BAD_CHECKSUM', id FROM r WHERE checksum IS DISTINCT FROM own UNION SELECT 'NO_LOCATOR', id FROM r WHERE locator IS NULL
    UNION SELECT 'INCOMPLETE_LOCATOR', id FROM r WHERE locator = 'RDF' AND (graph = '' OR predicate IS NULL) UNION SELECT 'MISSING_UPSTREAM', id FROM u WHERE source NOT IN (SELECT id FROM r) UNION SELECT 'LINEAGE_CYCLE', w.a FROM w JOIN w l ON w.b = l.a AND l.a = l.b UNION SELECT 'LINEAGE_CYCLE', a FROM w WHERE a = b""")
def ev_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that may not be compiled, and why."""
    part = table(spark, sf_dir, "part")
    source = "CASE WHEN p_partkey % 41 = 0 THEN -p_partkey WHEN p_partkey % 47 = 0 THEN p_partkey ELSE p_partkey div 2 END AS source"
    return E.validate(part.selectExpr(*[f"{e} AS {c}" for c, e in _STORED.items()]), part.where("p_partkey >= 2").selectExpr("p_partkey AS id", source))


_SAID = {"id": "p_partkey", "kind": "CASE WHEN p_partkey % 3 = 0 THEN 'ASSERTION' ELSE 'RDF_QUAD' END", "subject_kind": "CASE WHEN p_partkey % 19 = 0 THEN 'LITERAL' ELSE 'IRI' END", "subject": "p_brand", "predicate_kind": "CASE WHEN p_partkey % 17 = 0 THEN 'BLANK' ELSE 'IRI' END", "predicate": "CASE p_partkey % 5 WHEN 0 THEN 'urn:label' WHEN 1 THEN 'LABEL' WHEN 2 THEN 'urn:kind' WHEN 3 THEN 'urn:name' ELSE 'urn:other' END", "value": "p_size"}
_MAPPED = ((1, "urn:label", "LABEL", "label"), (2, "urn:kind", "CANDIDATE_KIND", "kind"), (3, "urn:name", "LABEL", "name"))


@query(f"WITH m(rank, predicate, semantic, label) AS (VALUES {', '.join(map(str, _MAPPED))}), s AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SAID.items())} FROM part), h AS (SELECT s.*, semantic, label, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM s JOIN m ON s.predicate IN (m.predicate, m.semantic) WHERE kind = 'ASSERTION' OR (subject_kind <> 'LITERAL' AND predicate_kind = 'IRI')) SELECT id, subject, semantic AS predicate, label, CAST(value AS VARCHAR) AS value FROM h WHERE k = 1")
def ev_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads and assertions by the meaning of their predicates."""
    mappings = spark.createDataFrame(list(_MAPPED), "rank int, predicate string, semantic string, label string")
    return E.normalise(table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in _SAID.items()]), mappings)


_SUPPORT = "CASE WHEN p_partkey % {n} = 0 THEN 'SINGLE_SOURCE' ELSE 'MULTI_SOURCE' END"
_TOLD = " UNION ALL ".join(
    f"SELECT concat('http://x/SalesObj', p_partkey) AS subject, '{predicate}' AS predicate, {value} AS value, {_SUPPORT.format(n=n)} AS support FROM part WHERE {where}"
    for predicate, value, n, where in (
        ("CANDIDATE_KIND", "CASE p_partkey % 4 WHEN 0 THEN 'ENTITY' WHEN 1 THEN 'EVENT' WHEN 2 THEN 'FIELD' ELSE 'OTHER' END", 7, "p_partkey % 9 <> 0"), ("LABEL", "p_name", 11, "p_partkey % 3 <> 0"),
        ("ALIAS", "concat('alias ', p_partkey % 7)", 5, "p_partkey % 5 < 2"), ("ALIAS", "p_type", 5, "p_partkey % 10 = 0"), ("DOMAIN", "concat('urn:a:OrderLine#Of-', p_partkey % 5)", 13, "p_partkey % 4 = 2 AND p_partkey % 12 <> 2"),
    )
)
_LOCAL = "list_filter(regexp_split_to_array({c}, '[/#:]'), lambda x: x <> '')[-1]"
_SNAKE = "lower(trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_'))"
_CODE, _OWNER = _SNAKE.format(c=_LOCAL.format(c="subject")), _SNAKE.format(c=_LOCAL.format(c="domain"))


@query(f"""WITH t AS ({_TOLD}), g AS (SELECT subject, min(value) FILTER (predicate = 'CANDIDATE_KIND') AS kind, min(value) FILTER (predicate = 'LABEL') AS label, min(value) FILTER (predicate = 'DOMAIN') AS domain, bool_and(support = 'MULTI_SOURCE') AS firm FROM t GROUP BY 1),
    o AS (SELECT subject, kind, {_CODE} AS code, CASE WHEN kind = 'FIELD' AND domain IS NOT NULL THEN 'FIELD:' || {_OWNER} || ':' || {_CODE} ELSE kind || ':' || {_CODE} END AS object_ref, coalesce(label, {_LOCAL.format(c="subject")}) AS name, 'ENTITY:' || {_OWNER} AS owner_ref, CASE WHEN firm THEN 'RECOMMENDED' ELSE 'VERIFY' END AS status FROM g WHERE kind <> 'OTHER')
    SELECT object_ref, kind, code, name, owner_ref, status FROM o UNION ALL SELECT 'ALIAS:' || code || ':' || left(sha256(value), 10), 'ALIAS', code || '_alias', value, object_ref, CASE WHEN support = 'MULTI_SOURCE' THEN 'RECOMMENDED' ELSE 'VERIFY' END FROM t JOIN o USING (subject) WHERE predicate = 'ALIAS'""")
def ev_alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and their aliases, proposed from claims."""
    table(spark, sf_dir, "part").createOrReplaceTempView("__told_part")
    return E.object_candidates(spark.sql(_TOLD.replace(" FROM part ", " FROM __told_part ")))


_STRATEGIES = (("ECONOMY", "TAKE_PRIMARY", 1), ("PROMO", "ASK_OWNER", 2), ("STANDARD", "TAKE_LATEST", 1))


@query(f"{_WITH}, s(word, strategy, priority) AS (VALUES {', '.join(map(str, _STRATEGIES))}) SELECT subject, predicate, coalesce(strategy, 'ASK_OWNER') AS strategy, coalesce(priority, 9) AS priority FROM f LEFT JOIN s ON word = split_part(predicate, ' ', 1) WHERE status = 'CONFLICT'")
def ev_conflict_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts with what is to be done about their sort; unlisted ones go to the owner."""
    known = spark.createDataFrame(list(_STRATEGIES), "word string, strategy string, priority int")
    found = E.findings(E.claims(records(spark, sf_dir))).where("status = 'CONFLICT'").withColumn("word", F.element_at(F.split("predicate", " "), 1))
    return found.join(known, "word", "left").select("subject", "predicate", F.coalesce("strategy", F.lit("ASK_OWNER")).alias("strategy"), F.coalesce("priority", F.lit(9)).alias("priority"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'MISSING' WHEN p_partkey % 5 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status FROM part WHERE p_partkey > 40 ORDER BY p_partkey LIMIT 25")
def ev_page_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of evidence whose bodies are checked against the index."""
    part = table(spark, sf_dir, "part")
    refs = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, F.lit("other")).otherwise(F.sha2("p_name", 256)).alias("checksum"))
    return E.page_of(refs, part.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body")), after=40, size=25)


@query("SELECT 'i' || i AS issue, 'root' || p_partkey % 4 AS root, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ids FROM part, (VALUES (0), (1)) k(k), LATERAL (SELECT CASE k WHEN 0 THEN p_partkey % 5 ELSE 10 + p_partkey % 3 END AS i) GROUP BY 1, 2")
def ev_issue_root_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From issues and roots to evidence."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.array(key % 5, 10 + key % 3).alias("issues"), F.array(F.concat(F.lit("root"), (key % 4).cast("string"))).alias("roots"))
    exploded = rows.select("id", F.explode("issues").alias("i"), "roots").select("id", F.concat(F.lit("i"), F.col("i").cast("string")).alias("issue"), F.explode("roots").alias("root"))
    return exploded.groupBy("issue", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("ids"))


@query(f"{_WITH} SELECT r.id, CASE WHEN r.id % 13 = 0 THEN 'EXCLUDED_GAP' WHEN f.status IN ('CONFLICT', 'DERIVED') THEN 'EXCLUDED_UNCERTAIN' ELSE 'ELIGIBLE' END AS eligibility FROM r LEFT JOIN f USING (subject, predicate)")
def ev_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps come before uncertain findings."""
    rows = records(spark, sf_dir)
    uncertain = E.findings(E.claims(rows)).where("status IN ('CONFLICT', 'DERIVED')").select("subject", "predicate")
    code = F.col("id").cast("string").alias("code")
    entry = lambda df, reason: df.select(F.col("id").alias("place"), code, F.col("subject").alias("name"), F.lit(reason).alias("reason"))
    found = E.eligibility(
        rows.select(F.col("id").alias("candidate"), F.lit("FIELD").alias("kind"), code, F.col("subject").alias("name"), F.col("predicate").alias("summary")),
        entry(rows.where("id % 13 = 0"), "gap"), entry(rows.join(uncertain, ["subject", "predicate"], "left_semi"), "uncertain"),
    )
    return found.select(F.col("candidate").alias("id"), "eligibility")


@query(f"{_WITH}, w AS (SELECT subject, predicate, value, row_number() OVER (PARTITION BY subject, predicate ORDER BY n DESC, value) AS k FROM c) SELECT subject, predicate, value FROM w WHERE k = 1")
def ev_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements as they are; of the values at issue, the one with most evidence."""
    return E.decide(E.claims(records(spark, sf_dir)))


@query(f"WITH r AS ({_REC}) SELECT id, CASE WHEN id % 17 = 0 THEN 'EXCLUDED' WHEN id % 19 = 0 THEN 'DEFERRED' WHEN derived THEN 'CANDIDATE_ONLY' ELSE 'KEEP' END AS resolution FROM r WHERE NOT (id % 17 = 0 AND derived)")
def ev_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    dropped = rows.where("id % 17 = 0 AND derived").select("id")
    resolution = F.when(F.col("id") % 17 == 0, "EXCLUDED").when(F.col("id") % 19 == 0, "DEFERRED").when(F.col("derived"), "CANDIDATE_ONLY").otherwise("KEEP")
    return rows.join(dropped, "id", "left_anti").select("id", resolution.alias("resolution"))


_SUM = "sha256(concat_ws('|', id, subject, predicate, value))"


@query(f"WITH r AS ({_REC}) SELECT id, {_SUM} AS checksum, id % 23 <> 0 AS valid FROM r")
def ev_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums computed anew against those stored, of which some are wrong."""
    own = E.checksum("id", "subject", "predicate", "value")
    stored = F.when(F.col("id") % 23 == 0, F.lit("bad")).otherwise(own)
    return records(spark, sf_dir).select("id", own.alias("checksum"), (stored == own).alias("valid"))


@query(f"WITH r AS ({_REC}) SELECT subject, count(DISTINCT root) AS n_roots, count(DISTINCT id) AS n_evidence FROM r GROUP BY 1 HAVING count(DISTINCT predicate) >= 2")
def ev_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From objects over their claims to distinct evidence."""
    members = records(spark, sf_dir).groupBy("subject", "predicate").agg(F.collect_set(F.struct("id", "root")).alias("ev"))
    rows = members.select("subject", "predicate", F.explode("ev").alias("e"))
    return rows.groupBy("subject").agg(F.count_distinct("e.root").alias("n_roots"), F.count_distinct("e.id").alias("n_evidence"), F.count_distinct("predicate").alias("k")).where("k >= 2").drop("k")


@query(f"WITH r AS ({_REC}), s AS (SELECT subject, predicate, root, count(*) AS n, min(id) AS one FROM r GROUP BY 1, 2, 3) SELECT subject, predicate, root, CASE WHEN n = 1 THEN one END AS bound, n = 1 AS unique_binding FROM s")
def ev_slot_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role (predicate and root) of a subject is bound if one record alone has it."""
    slots = records(spark, sf_dir).groupBy("subject", "predicate", "root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    return slots.select("subject", "predicate", "root", F.when(F.col("n") == 1, F.col("one")).alias("bound"), (F.col("n") == 1).alias("unique_binding"))


@query("SELECT command, min(event_id) AS first_event, count(DISTINCT event_type) > 1 AS mismatch FROM (SELECT user_id * 100 + event_id % 10 AS command, event_id, event_type FROM events) GROUP BY 1")
def gov_idempotent_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command counts once; one id with different contents is an error."""
    return E.idempotent(table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 10).alias("command"), "event_id", "event_type"), "command", "event_id", "event_type").withColumnRenamed("first", "first_event")


@query("SELECT o_orderkey, o_orderkey % 4 AS expected, o_custkey % 4 AS actual, CASE WHEN o_orderkey % 4 = o_custkey % 4 THEN 'APPLIED' ELSE 'CONFLICT' END AS outcome FROM orders")
def gov_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optimistic lock: a write goes through if the revision is the one it expects."""
    expected, actual = F.col("o_orderkey") % 4, F.col("o_custkey") % 4
    return table(spark, sf_dir, "orders").select("o_orderkey", expected.alias("expected"), actual.alias("actual"), F.when(expected == actual, "APPLIED").otherwise("CONFLICT").alias("outcome"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = o_orderkey % 10 THEN 'SELF_APPROVAL' WHEN o_totalprice > 400000 THEN 'BASE_CONFLICT' ELSE 'PUBLISHED' END AS outcome FROM orders")
def gov_four_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nobody publishes their own draft; a changed base is a conflict."""
    outcome = F.when(F.col("o_custkey") % 10 == F.col("o_orderkey") % 10, "SELF_APPROVAL").when(F.col("o_totalprice") > 400000, "BASE_CONFLICT").otherwise("PUBLISHED")
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"))


_ORIGINAL = {
    "rules": "SELECT concat('k', p_partkey) AS code FROM part WHERE p_partkey % 6 = 0",
    "exclusions": "SELECT p_partkey AS position, concat('k', p_partkey % 1000) AS code, p_name AS name, CASE WHEN p_size % 9 = 0 THEN '' ELSE concat('gap ', p_partkey) END AS reason FROM part WHERE p_size % 5 = 0",
    "pending": "SELECT p_partkey AS position, concat(CASE p_size % 3 WHEN 0 THEN 'deferred:FIELD:' WHEN 1 THEN 'candidate:RULE:' ELSE '' END, 'k', p_partkey % 1500) AS code, p_name AS name, concat('doubt ', p_partkey) AS reason FROM part WHERE p_size % 4 = 1",
    "decisions": "SELECT o_orderkey AS position, concat('d', o_orderkey) AS decision, CASE WHEN o_custkey % 2 = 0 THEN 'FIELD' ELSE 'RULE' END AS kind, concat('k', o_custkey) AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 'KEEP' WHEN '2-HIGH' THEN 'EXCLUDED' WHEN '3-MEDIUM' THEN 'DEFERRED' WHEN '5-LOW' THEN 'KEEP_WITHOUT_ENUM_MEMBER' ELSE 'CANDIDATE_ONLY' END AS disposition, concat('c', o_custkey) AS name FROM orders",
    "evidence": "SELECT concat('d', o_orderkey) AS decision, concat('k', o_custkey) AS code, concat('e', l_partkey) AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "candidates": "SELECT concat('n', p_partkey) AS candidate, CASE WHEN p_partkey % 50 = 7 THEN 'PENDING_ASSET' WHEN p_partkey % 2 = 0 THEN 'FIELD' ELSE 'RULE' END AS kind, CASE WHEN p_partkey % 40 = 3 THEN NULL ELSE concat('k', p_partkey) END AS code, p_name AS name, p_type AS summary FROM part WHERE p_partkey % 3 <> 1",
}


def originals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Exclusions, pending entries, decisions and candidates, made from parts, orders and their lines."""
    tables = {t: table(spark, sf_dir, t) for t in ("part", "orders", "lineitem")}
    return {name: spark.sql(sql.replace("FROM part", "FROM {part}").replace("FROM orders", "FROM {orders}").replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}"), **{t: df for t, df in tables.items() if re.search(rf"(FROM|JOIN) {t}\b", sql)}) for name, sql in _ORIGINAL.items()}


# The lists after all decisions: once its first entries are taken away by KEEPs, a code's list starts anew at the last KEEP.
_AFTER = f"""WITH {', '.join(f'{name} AS MATERIALIZED ({sql})' for name, sql in _ORIGINAL.items())},
    x AS (SELECT 'EXCLUSION' AS list, position, code, name, reason FROM exclusions UNION ALL SELECT 'PENDING', position, code, name, reason FROM pending),
    g AS (SELECT 'EXCLUSION' AS list, code AS key, position, decision, code, name, disposition, CASE disposition WHEN 'KEEP' THEN -1 ELSE 1 END AS step FROM decisions WHERE disposition IN ('KEEP', 'EXCLUDED')
        UNION ALL SELECT 'PENDING', concat('deferred:', kind, ':', code), position, decision, code, name, disposition, CASE disposition WHEN 'KEEP' THEN -1 ELSE 1 END FROM decisions WHERE disposition IN ('KEEP', 'DEFERRED')
        UNION ALL SELECT 'PENDING', concat('candidate:', kind, ':', code), position, decision, code, name, disposition, CASE disposition WHEN 'KEEP' THEN -1 ELSE 1 END FROM decisions WHERE disposition = 'KEEP' OR (disposition = 'CANDIDATE_ONLY' AND NOT (kind = 'RULE' AND code IN (SELECT code FROM rules)))),
    o AS (SELECT list, 0 AS added, position, code, name, reason, NULL AS decision, NULL AS refs FROM (SELECT *, row_number() OVER (PARTITION BY list, code ORDER BY position) AS nth FROM x) t WHERE nth > (SELECT count(*) FROM g WHERE g.list = t.list AND g.key = t.code AND step = -1)),
    f AS (SELECT * FROM g a WHERE step = 1 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.list = a.list AND b.key = a.key AND b.step = -1 AND b.position > a.position) AND NOT EXISTS (SELECT 1 FROM o WHERE o.list = a.list AND o.code = a.key)
        QUALIFY row_number() OVER (PARTITION BY list, key ORDER BY position) = 1),
    lists AS (SELECT * FROM o UNION ALL SELECT list, 1, position, key, name, '标准化决定 ' || decision || CASE disposition WHEN 'EXCLUDED' THEN ' 将该对象排除。' WHEN 'DEFERRED' THEN ' 延后该对象。' ELSE ' 仅登记为候选。' END, decision,
        (SELECT coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref), '') FROM evidence e WHERE e.decision = f.decision AND e.code = f.code) FROM f)"""


@query(f"{_AFTER} SELECT list, code, name, reason, decision, refs FROM lists")
def ev_decided_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions and pending entries after all decisions in their order."""
    t = originals(spark, sf_dir)
    return E.apply_decisions(t["exclusions"], t["pending"], t["rules"], t["decisions"], t["evidence"]).drop("place")


@query(f"""{_AFTER}, gap AS (SELECT code, arg_max(reason, (added, position)) AS reason FROM lists WHERE list = 'EXCLUSION' GROUP BY 1), doubt AS (SELECT CASE WHEN contains(code, ':') THEN split_part(code, ':', 3) ELSE code END AS code, arg_max(reason, (added, position)) AS reason FROM lists WHERE list = 'PENDING' GROUP BY 1),
    j AS (SELECT c.*, nullif(g.reason, '') AS gap, CASE WHEN kind = 'PENDING_ASSET' THEN nullif(summary, '') ELSE nullif(d.reason, '') END AS doubt FROM candidates c LEFT JOIN gap g USING (code) LEFT JOIN doubt d USING (code))
    SELECT 'conclusion:' || candidate AS conclusion, candidate, name, CASE WHEN gap IS NOT NULL THEN 'EXCLUDED_GAP' WHEN doubt IS NOT NULL THEN 'EXCLUDED_UNCERTAIN' ELSE 'ELIGIBLE' END AS eligibility, coalesce(gap, doubt) AS reason FROM j
    UNION ALL SELECT 'conclusion:gap:' || code, NULL, name, 'EXCLUDED_GAP', reason FROM lists l WHERE list = 'EXCLUSION' AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.code = l.code)""")
def ev_modeling_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be modelled once all decisions are applied, with a row for each exclusion that no candidate stands for."""
    t = originals(spark, sf_dir)
    lists = E.apply_decisions(t["exclusions"], t["pending"], t["rules"], t["decisions"], t["evidence"])
    lists = materialize(lists, "lists")
    return E.eligibility(t["candidates"], lists.where("list = 'EXCLUSION'"), lists.where("list = 'PENDING'"))


_CLOSED = {
    "sources": "SELECT concat('s', s_suppkey) AS connection, concat('v', s_suppkey) AS snapshot, array(concat('v', s_suppkey - 1), concat('v', s_suppkey div 2)) AS upstream FROM supplier",
    "evidence": "SELECT concat('e', p_partkey) AS id FROM part WHERE p_partkey % 13 <> 4",
    "claims": "SELECT concat('c', ps) AS claim, concat('s', sk) AS source, array(concat('e', pk), concat('e', pk + 1)) AS refs, array(concat('c', ps div 2)) AS upstream FROM (SELECT l_orderkey * 10 + l_linenumber AS ps, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM lineitem GROUP BY 1)",
}


def _duck(sql: str) -> str:
    return sql.replace("array(", "list_value(").replace(" div ", " // ")


@query(f"""WITH {', '.join(f'{name} AS ({_duck(sql)})' for name, sql in _CLOSED.items())}, r AS (SELECT claim, unnest(refs) AS id FROM claims), u AS (SELECT claim, source, unnest(upstream) AS up FROM claims)
    SELECT 'MISSING_SOURCE' AS code, claim FROM claims WHERE source NOT IN (SELECT connection FROM sources) UNION SELECT 'MISSING_EVIDENCE', claim FROM r WHERE id NOT IN (SELECT id FROM evidence) UNION SELECT 'MISSING_UPSTREAM', claim FROM u WHERE up NOT IN (SELECT claim FROM claims)
    UNION SELECT 'OPEN_UPSTREAM', u.claim FROM u JOIN claims c ON c.claim = u.up JOIN sources a ON a.connection = u.source JOIN sources b ON b.connection = c.source WHERE NOT list_contains(a.upstream, b.snapshot)""")
def ev_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a frozen set that refer to what it doesn't hold."""
    part, supplier, lineitem = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    frames = {name: spark.sql(sql.replace(f"FROM {t}", f"FROM {{{t}}}"), **{t: df}) for (name, sql), (t, df) in zip(_CLOSED.items(), (("supplier", supplier), ("part", part), ("lineitem", lineitem)), strict=True)}
    return E.unclosed(frames["sources"], frames["evidence"], frames["claims"])


_BODY = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus)"
_ITEM = "CASE WHEN o_orderkey % 1511 = 777 THEN 'bad' ELSE sha2({b}, 256) END"


@query(f"""WITH i AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey AS ref, o_orderkey % 1511 <> 777 AND o_orderkey % 1999 <> 1200 AS good FROM orders), s AS (SELECT min(place) AS stop FROM i WHERE NOT good), b AS (SELECT (place - 1) // 100 + 1 AS batch, count(*) AS n_items, count(*) FILTER (place < coalesce(stop, place + 1)) AS n_completed, any_value(stop) AS stop, min(ref) FILTER (place = stop) AS failed FROM i, s GROUP BY 1)
    SELECT batch, CASE WHEN n_completed = n_items THEN 'COMPLETED' WHEN failed IS NOT NULL THEN 'FAILED' ELSE 'NOT_RUN' END AS status, n_items, n_completed, failed FROM b""")
def ev_verify_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a check of all bodies in order comes, by batches of 100."""
    orders = table(spark, sf_dir, "orders")
    items = orders.selectExpr("o_orderkey AS position", "o_orderkey AS ref", f"{_ITEM.format(b=_BODY)} AS checksum")
    return E.verify_batches(items, orders.where("o_orderkey % 1999 <> 1200").selectExpr("o_orderkey AS ref", f"{_BODY} AS body"))[0]


_WRITES = "SELECT event_type AS key, event_id AS seq, 1 + event_id // 25 - event_id % 3 AS expected FROM events"


@query(f"""WITH RECURSIVE w AS MATERIALIZED ({_WRITES}), n AS MATERIALIZED (SELECT a.key, a.seq, min(b.seq) AS next FROM w a JOIN w b ON a.key = b.key AND b.expected = a.expected + 1 AND b.seq > a.seq GROUP BY 1, 2),
    d AS (SELECT key, min(seq) AS seq FROM w WHERE expected = 1 GROUP BY 1 UNION ALL SELECT d.key, next FROM d JOIN n ON n.key = d.key AND n.seq = d.seq)
    SELECT w.key, w.seq, expected, CASE WHEN d.seq IS NOT NULL THEN 'APPLIED' ELSE 'STALE' END AS outcome, 1 + count(d.seq) OVER (PARTITION BY w.key ORDER BY w.seq) AS revision FROM w LEFT JOIN d ON d.key = w.key AND d.seq = w.seq""")
def gov_guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to five objects, each with the revision that it expects."""
    writes = table(spark, sf_dir, "events").selectExpr("event_type AS key", "event_id AS seq", "1 + event_id div 25 - event_id % 3 AS expected")
    return V.guarded_writes(writes, "key", "seq", "expected")


# Two actions for each order: a review and a publication, of which some are made by the author, by the wrong role, late or without a reason.
_ACTS = {
    "roles": "SELECT DISTINCT o_orderpriority AS space, c_custkey AS actor, CASE c_custkey % 7 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'EDITOR' WHEN 2 THEN 'PUBLISHER' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'PUBLISHER' ELSE 'REVIEWER' END END AS role FROM orders JOIN customer ON c_custkey < 14",
    "drafts": "SELECT o_orderkey AS request, o_orderpriority AS space, o_custkey % 14 AS author, (o_orderkey * 5 + 3) % 14 AS reviewer, (o_orderkey * 3 + 2) % 14 AS publisher, o_custkey % 9 AS luck FROM orders",
    "good": "SELECT *, author <> reviewer AND author <> publisher AND (reviewer % 7 = 0 OR (reviewer % 7 > 2 AND reviewer % 2 = 1)) AND (publisher % 7 IN (0, 2) OR (publisher % 7 > 2 AND publisher % 2 = 0)) AND luck NOT IN (0, 1, 2, 3, 8) AS fine FROM drafts",
}
_REVIEWED = "SELECT request, request * 4 + 1 AS seq, reviewer AS actor, 'REVIEW' AS action, CASE WHEN luck = 0 THEN 'REJECT' ELSE 'APPROVE' END AS decision, CASE WHEN luck = 1 THEN 7 ELSE 1 END AS expected, CASE WHEN request % 2 = 0 THEN '理由' END AS reason FROM good"
_PUBLISHED = "SELECT request, request * 4 + {n} AS seq, publisher AS actor, 'PUBLISH' AS action, NULL AS decision, CASE WHEN luck = 2 THEN 1 ELSE 2 END AS expected, CASE WHEN luck = 3 THEN 'ok' ELSE '发布' END AS reason FROM good"
_ACTIONS = f"{_REVIEWED} UNION ALL {_PUBLISHED.format(n=2)} UNION ALL {_PUBLISHED.format(n=3)} WHERE request % 5 = 0"


@query(f"""WITH RECURSIVE {', '.join(f'{name} AS MATERIALIZED ({sql})' for name, sql in _ACTS.items())},
    q AS MATERIALIZED (SELECT request, space, author, last_value(CASE WHEN fine THEN request END IGNORE NULLS) OVER (PARTITION BY space ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND CASE WHEN luck = 8 THEN 101 ELSE 1 END PRECEDING) AS base FROM good),
    m AS (SELECT space, actor, bool_or(role IN ('REVIEWER', 'ADMIN')) AS reviews, bool_or(role IN ('PUBLISHER', 'ADMIN')) AS publishes FROM roles GROUP BY 1, 2),
    a AS MATERIALIZED (SELECT x.*, space, base, CASE WHEN author = x.actor THEN 'SELF' WHEN NOT coalesce(CASE action WHEN 'PUBLISH' THEN publishes ELSE reviews END, false) THEN 'FORBIDDEN' WHEN expected <> CASE action WHEN 'PUBLISH' THEN 2 ELSE 1 END THEN 'STALE'
        WHEN NOT (coalesce(regexp_matches(reason, '[\u3400-\u9fff]'), false) OR (action = 'REVIEW' AND decision = 'APPROVE')) THEN 'NO_REASON' END AS wrong FROM ({_ACTIONS}) x JOIN q USING (request) LEFT JOIN m USING (space, actor)),
    r AS (SELECT request, min(seq) AS stamp, arg_min(CASE decision WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'CHANGES_REQUESTED' END, seq) AS status FROM a WHERE action = 'REVIEW' AND wrong IS NULL GROUP BY 1),
    t AS MATERIALIZED (SELECT request, space, base, min(seq) AS stamp FROM a JOIN r USING (request) WHERE action = 'PUBLISH' AND wrong IS NULL AND status = 'APPROVED' AND seq > r.stamp GROUP BY 1, 2, 3),
    n AS MATERIALIZED (SELECT t.base, arg_min(t.request, t.stamp) AS next FROM t JOIN t b ON b.request = t.base AND b.space = t.space AND t.stamp > b.stamp GROUP BY 1),
    d AS (SELECT arg_min(request, stamp) AS request, 1 AS version FROM t WHERE base IS NULL GROUP BY space UNION ALL SELECT next, version + 1 FROM d JOIN n ON n.base = d.request),
    z AS (SELECT a.request, a.seq, CASE WHEN action = 'PUBLISH' AND NOT (coalesce(r.status = 'APPROVED' AND a.seq > r.stamp, false) AND a.seq <= coalesce(t.stamp, a.seq)) THEN 'NOT_APPROVED' WHEN action = 'REVIEW' AND a.seq > coalesce(r.stamp, a.seq) THEN 'NOT_OPEN' WHEN wrong IS NOT NULL THEN wrong
        WHEN action = 'REVIEW' THEN CASE decision WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'CHANGES_REQUESTED' END WHEN version IS NOT NULL THEN 'PUBLISHED' ELSE 'CONFLICTED' END AS outcome, version FROM a LEFT JOIN r USING (request) LEFT JOIN t USING (request) LEFT JOIN d USING (request))
    SELECT request, seq, outcome, CASE WHEN outcome = 'PUBLISHED' THEN version END AS version FROM z""")
def gov_review_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and publications in their order, with the versions that come of them; some drafts begin from an old version."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    roles = spark.sql(_ACTS["roles"].replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), orders=orders.select("o_orderpriority").distinct(), customer=customer)
    drafts = spark.sql(_ACTS["drafts"].replace("FROM orders", "FROM {orders}"), orders=orders)
    good = spark.sql(_ACTS["good"].replace("FROM drafts", "FROM {drafts}"), drafts=drafts)
    # What was fine last, of all before and of all but the last hundred before.
    seen = ranged.over(good.withColumn("sure", F.when(F.col("fine"), F.col("request"))), ["space"], ["request"], new=("last_before", "sure"), n=("row_number",))
    older = seen.select("space", (F.col("n") + 100).alias("n"), F.col("new").alias("old"))
    requests = seen.join(older, ["space", "n"], "left").select("request", "space", "author", F.when(F.col("luck") == 8, F.col("old")).otherwise(F.col("new")).alias("base"))
    return V.review_and_publish(requests, spark.sql(_ACTIONS.replace("FROM good", "FROM {good}"), good=good), roles)
