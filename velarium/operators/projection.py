"""Projections of a model document into catalog tables, and what follows from kinds, types and formulas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.session import materialize


def field_role(kind: Column, is_metric: Column) -> Column:
    """The role of a field that a semantic type is mapped to (fixed values)."""
    number = kind.isin("AMOUNT", "NUMBER", "RATIO")
    return (
        F.when(kind == "ID", "PRIMARY_KEY").when(kind == "FOREIGN_KEY", "JOIN_KEY").when(number & is_metric, "MEASURE")
        .when(number | kind.isin("CODE", "ENUM", "HIERARCHY", "LIFECYCLE", "BOOLEAN"), "DIMENSION").when(kind.isin("DATE", "DATETIME", "TIME"), "TIME").otherwise("TEXT")
    )


def relation_type(source: Column, target: Column) -> Column:
    """By the kinds of a relation's ends (fixed values)."""
    return F.when((source == "EVENT") & (target == "ENTITY"), "EVENT_ENTITY").when((source == "ENTITY") & (target == "ENTITY"), "ENTITY_ENTITY").otherwise("EVENT_EVENT")


def editable(formula: Column, aggregation: Column, fields: Column) -> Column:
    """Whether a metric is one SUM or AVG of one field."""
    return F.lower(aggregation).isin("sum", "avg") & (F.size(fields) == 1) & F.regexp_replace(formula, r"\s", "").rlike(r"^(?i:sum|avg)\([^(),+\-*/]+\)$")


#: A model document: its tables with their fields, relations and metrics.
DOCUMENT = "tables array<struct<id:string,kind:string,evidence:array<string>,fields:array<struct<id:string,type:string,is_metric:boolean>>>>, relations array<struct<id:string,source:string,target:string,evidence:array<string>>>, metrics array<struct<id:string,event:string,aggregation:string,formula:string,fields:array<string>,evidence:array<string>>>"


def catalog_tables(documents: DataFrame, key: str, payload: str) -> dict[str, DataFrame]:
    """documents (key, payload as JSON of DOCUMENT) -> objects, fields, relations and metrics as tables with what is derived. A payload of another shape raises."""
    parsed = documents.select(key, F.from_json(payload, DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    objects = parsed.select(key, F.explode("d.tables").alias("t")).select(key, F.col("t.id").alias("object"), F.col("t.kind").alias("kind"), F.size("t.evidence").alias("n_evidence"), F.col("t.fields").alias("fields"))
    fields = objects.select(key, "object", F.posexplode("fields").alias("ordinal", "f")).select(key, "object", "ordinal", F.col("f.id").alias("field"), F.col("f.type").alias("type"), field_role(F.col("f.type"), F.col("f.is_metric")).alias("role"))
    # Tables are far more rows than their documents' files suggest: without the hint, they would be guessed small and broadcast.
    ends = objects.select(key, "object", "kind").hint("merge")
    relations = parsed.select(key, F.explode("d.relations").alias("r")).select(key, F.col("r.id").alias("relation"), F.col("r.source").alias("source"), F.col("r.target").alias("target"), F.size("r.evidence").alias("n_evidence"))
    relations = relations.join(ends.toDF(key, "source", "source_kind"), [key, "source"], "left").join(ends.toDF(key, "target", "target_kind"), [key, "target"], "left")
    relations = relations.select(key, "relation", "source", "target", relation_type(F.col("source_kind"), F.col("target_kind")).alias("type"), (F.col("source_kind").isNotNull() & F.col("target_kind").isNotNull()).alias("resolved"), "n_evidence")
    metrics = parsed.select(key, F.explode("d.metrics").alias("m")).select(key, F.col("m.id").alias("metric"), F.col("m.event").alias("event"), editable(F.col("m.formula"), F.col("m.aggregation"), F.col("m.fields")).alias("editable"), F.col("m.fields").alias("fields"), F.size("m.evidence").alias("n_evidence"))
    return {"objects": objects.drop("fields"), "fields": fields, "relations": relations, "metrics": metrics}


def publication_checks(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """key, check, n: how many things fail each of the four checks; documents without failures have no row."""
    objects, fields, relations, metrics = (tables[n] for n in ("objects", "fields", "relations", "metrics"))
    count = lambda df, name: df.groupBy(key).agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    twice = fields.groupBy(key, "object").agg((F.count(F.lit(1)) > F.count_distinct("field")).alias("bad")).where("bad")
    needed = metrics.select(key, "metric", "event", F.explode("fields").alias("field"))
    lacking = needed.join(fields.select(key, F.col("object").alias("event"), "field").distinct().hint("merge"), [key, "event", "field"], "left_anti").select(key, "metric").distinct()
    unsourced = [df.where("n_evidence = 0").select(key) for df in (objects, relations, metrics)]
    return count(relations.where("NOT resolved"), "RELATION_ENDPOINTS").unionByName(count(twice, "FIELD_UNIQUENESS")).unionByName(count(lacking, "METRIC_DEPENDENCIES")).unionByName(count(unsourced[0].union(unsourced[1]).union(unsourced[2]), "SOURCE_EVIDENCE"))


def resolve_targets(rules: DataFrame, metrics: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """rules (id, target, owner), the others (code, name) -> id, target_type, name, status: a metric by the target, else an event, else an entity, by the owner or the target."""
    own = F.coalesce("owner", "target")
    out = rules.withColumn("__own", own)
    for kind, df, on in (("METRIC", metrics, "target"), ("EVENT", events, "__own"), ("ENTITY", entities, "__own")):
        out = out.join(df.select(F.col("code").alias(on), F.col("name").alias(f"__{kind}")).dropDuplicates([on]), on, "left")
    kinds = ("METRIC", "EVENT", "ENTITY")
    found = F.coalesce(*[F.when(F.col(f"__{k}").isNotNull(), F.lit(k)) for k in kinds])
    return out.select("id", found.alias("target_type"), F.coalesce(*[F.col(f"__{k}") for k in kinds]).alias("name"), F.when(found.isNull(), "UNRESOLVED_TARGET").otherwise("NEEDS_STRUCTURE").alias("status"))


def look_up(questions: DataFrame, triggers: DataFrame, aliases: DataFrame) -> DataFrame:
    """questions (id, text), triggers (word, rule, priority), aliases (word, object, priority) -> id, rule, object: by the words of a question, the first rule and the first object in order of priority."""
    words = questions.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word"))
    first = lambda df, name: words.join(df, "word").groupBy("id").agg(F.min(F.struct("priority", name)).alias("m")).select("id", f"m.{name}")
    return questions.select("id").join(first(triggers, "rule"), "id", "left").join(first(aliases, "object"), "id", "left")


def root_events(metrics: DataFrame, refs: DataFrame) -> DataFrame:
    """metrics (id, event), refs (metric, position, ref) -> id, event: a metric's own event, else that of the first metric that its formula names, and so on; null at a dead end or in a cycle.

    A pointer leads from each metric to its first reference; pointers double at each round, so a chain of n takes log n of them.
    """
    first = refs.groupBy(F.col("metric").alias("id")).agg(F.min_by("ref", "position").alias("next"))
    at = materialize(metrics.select("id", "event").join(first, "id", "left").withColumn("next", F.when(F.col("event").isNull(), F.col("next"))), "root-events")
    left = -1
    while True:
        open_ = at.where("event IS NULL AND next IS NOT NULL").count()
        if open_ in (0, left):
            return at.select("id", "event")
        left = open_
        ahead = at.select(F.col("id").alias("next"), F.col("event").alias("__e"), F.col("next").alias("__n"))
        at = materialize(at.join(ahead, "next", "left").select("id", F.coalesce("event", "__e").alias("event"), F.when(F.coalesce("event", "__e").isNull(), F.col("__n")).alias("next")), "root-events")
