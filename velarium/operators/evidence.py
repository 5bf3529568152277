"""Evidence records -> claims -> findings -> candidates, all as aggregates that combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.operators.ranged import over
from velarium.operators.ranking import places
from velarium.session import materialize


def claims(records: DataFrame) -> DataFrame:
    """subject, predicate, value, support, n. Support is MULTI from several roots; evidence that is all derived is DERIVED_ONLY."""
    own_roots = F.count_distinct(F.when(~F.col("derived"), F.col("root")))
    support = F.when(F.bool_and("derived"), "DERIVED_ONLY").when(own_roots > 1, "MULTI").otherwise("SINGLE")
    return records.groupBy("subject", "predicate", "value").agg(support.alias("support"), F.count(F.lit(1)).alias("n"))


def claim_members(records: DataFrame) -> DataFrame:
    """subject, predicate, value, ids (in order, comma-joined), n_roots."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",")
    return records.groupBy("subject", "predicate", "value").agg(ids.alias("ids"), F.count_distinct("root").alias("n_roots"))


def findings(claims_: DataFrame) -> DataFrame:
    """subject, predicate, n_values, status: CONFLICT if values differ, else by the support."""
    any_of = lambda s: F.bool_or(F.col("support") == s)
    n = F.count(F.lit(1))
    status = F.when(n > 1, "CONFLICT").when(any_of("MULTI"), "CONSISTENT").when(any_of("SINGLE"), "SINGLE").otherwise("DERIVED")
    return claims_.groupBy("subject", "predicate").agg(n.alias("n_values"), status.alias("status"))


def candidates(findings_: DataFrame) -> DataFrame:
    """subject, decision, n_conflicts: BLOCKED by a conflict, RECOMMENDED if all is consistent, else VERIFY."""
    conflict = F.col("status") == "CONFLICT"
    decision = F.when(F.bool_or(conflict), "BLOCKED").when(F.bool_and(F.col("status") == "CONSISTENT"), "RECOMMENDED").otherwise("VERIFY")
    return findings_.groupBy("subject").agg(decision.alias("decision"), F.count_if(conflict).alias("n_conflicts"))


#: What two claims say of each other; the first that holds (fixed values).
RELATIONS = ("UNSUPPORTED", "COMPLEMENTS", "SCOPE_DIFFERENCE", "TEMPORAL_DRIFT", "CORROBORATES", "CONFLICTS")


def compare(claims_: DataFrame, pairs: DataFrame) -> DataFrame:
    """claims (id, subject, predicate, value, scope, effective, kind, n_refs), pairs (left_id, right_id) -> left_id, right_id, relation.

    A claim without evidence, or a GAP, supports nothing. Claims about different things, or of which one is a
    frozen record that says the same, complement each other. Only claims of one scope and, where both name
    one, one time corroborate or conflict. Two equi joins; a pair with an unknown claim has no row.
    """
    side = lambda n: claims_.select(*[F.col(c).alias(f"{n}_{c}") for c in ("id", "subject", "predicate", "value", "scope", "effective", "kind", "n_refs")])
    both = pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    l, r = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))  # noqa: E741
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    same = lambda c: l(c).eqNullSafe(r(c))
    relation = (
        F.when((l("n_refs") == 0) | (r("n_refs") == 0) | (l("kind") == "GAP") | (r("kind") == "GAP"), "UNSUPPORTED")
        .when(~same("subject") | ~same("predicate"), "COMPLEMENTS")
        .when(~same("scope"), "SCOPE_DIFFERENCE")
        .when(given(l("effective")) & given(r("effective")) & ~same("effective"), "TEMPORAL_DRIFT")
        .when(same("value"), F.when((l("kind") == "FROZEN_RECORD") | (r("kind") == "FROZEN_RECORD"), "COMPLEMENTS").otherwise("CORROBORATES"))
        .otherwise("CONFLICTS")
    )
    return both.select("left_id", "right_id", relation.alias("relation"))


def decide(claims_: DataFrame) -> DataFrame:
    """subject, predicate, value: of the values at issue the one with most evidence; of several, the first in order."""
    best = F.min(F.struct((-F.col("n")).alias("o"), F.col("value"))).alias("b")
    return claims_.groupBy("subject", "predicate").agg(best).select("subject", "predicate", "b.value")


def validate(records: DataFrame, upstream: DataFrame) -> DataFrame:
    """records (id, checksum, own, locator, graph, subject, predicate), upstream (id, source) -> code, id of what is wrong.

    own is the checksum computed anew; an RDF locator names a graph, a subject and a predicate.
    """
    from velarium.operators.modelcheck import reaches_cycle

    code = lambda df, name: df.select(F.lit(name).alias("code"), F.col("id").cast("long").alias("id"))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    known = records.select(F.col("id").alias("source")).distinct()
    found = [
        code(records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DUPLICATE_ID"),
        code(records.where(~F.col("checksum").eqNullSafe(F.col("own"))), "BAD_CHECKSUM"),
        code(records.where(missing("locator")), "NO_LOCATOR"),
        code(records.where((F.col("locator") == "RDF") & (missing("graph") | missing("subject") | missing("predicate"))), "INCOMPLETE_LOCATOR"),
        code(upstream.join(known, "source", "left_anti"), "MISSING_UPSTREAM"),
        code(reaches_cycle(upstream.select(F.col("id").alias("a"), F.col("source").alias("b"))).withColumnRenamed("node", "id"), "LINEAGE_CYCLE"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def normalise(statements: DataFrame, mappings: DataFrame) -> DataFrame:
    """statements (id, kind, subject_kind, subject, predicate_kind, predicate, value), mappings (rank, predicate, semantic, label) -> id, subject, predicate, label, value.

    A statement is mapped by its predicate's name or meaning, by the mapping of least rank. Quads about literals, or
    whose predicate is no IRI, and unmapped statements have no row.
    """
    keys = mappings.select("rank", "semantic", "label", F.explode(F.array_distinct(F.array("predicate", "semantic"))).alias("predicate"))
    first = keys.groupBy("predicate").agg(F.min(F.struct("rank", "semantic", "label")).alias("m"))
    usable = (F.col("kind") == "ASSERTION") | ((F.col("subject_kind") != "LITERAL") & (F.col("predicate_kind") == "IRI"))
    return statements.where(usable).join(first, "predicate").select("id", "subject", F.col("m.semantic").alias("predicate"), "m.label", F.col("value").cast("string").alias("value"))


#: What a subject may be proposed as (fixed values).
CANDIDATE_KINDS = ("ENTITY", "EVENT", "FIELD", "RELATION", "DIMENSION", "METRIC", "HIERARCHY", "RULE", "TIME_SEMANTIC")


def object_candidates(claims_: DataFrame) -> DataFrame:
    """claims (subject, predicate, value, support) -> object_ref, kind, code, name, owner_ref, status: an object for each subject that claims a kind, and an alias for each name that it also goes by.

    Of several values the first in order counts. An object is RECOMMENDED if all that is said of it has several
    sources, else to VERIFY; an alias by its own claim.
    """
    from velarium.functions.scalar import local_name, snake_case

    of = lambda name: F.min(F.when(F.col("predicate") == name, F.col("value")))
    firm = F.bool_and(F.col("support") == "MULTI_SOURCE")
    subjects = claims_.groupBy("subject").agg(of("CANDIDATE_KIND").alias("kind"), of("LABEL").alias("label"), of("DOMAIN").alias("domain"), firm.alias("firm")).where(F.col("kind").isin(*CANDIDATE_KINDS))
    code, owner = snake_case(local_name(F.col("subject"))), snake_case(local_name(F.col("domain")))
    own = F.when((F.col("kind") == "FIELD") & owner.isNotNull(), F.concat(F.lit("FIELD:"), owner, F.lit(":"), code)).otherwise(F.concat("kind", F.lit(":"), code))
    named = subjects.select("subject", "kind", code.alias("code"), own.alias("object_ref"), F.coalesce("label", local_name(F.col("subject"))).alias("name"), F.concat(F.lit("ENTITY:"), owner).alias("owner_ref"), F.when(F.col("firm"), "RECOMMENDED").otherwise("VERIFY").alias("status"))
    names = ("object_ref", "kind", "code", "name", "owner_ref", "status")
    alias = claims_.where("predicate = 'ALIAS'").select("subject", F.col("value").alias("alias"), "support").join(named.select("subject", "code", "object_ref"), "subject")
    aliases = alias.select(
        F.concat(F.lit("ALIAS:"), "code", F.lit(":"), F.left(F.sha2("alias", 256), F.lit(10))).alias("object_ref"), F.lit("ALIAS").alias("kind"), F.concat("code", F.lit("_alias")).alias("code"),
        F.col("alias").alias("name"), F.col("object_ref").alias("owner_ref"), F.when(F.col("support") == "MULTI_SOURCE", "RECOMMENDED").otherwise("VERIFY").alias("status"),
    )
    return named.select(*names).unionByName(aliases)


def compile_package(records: DataFrame) -> dict[str, DataFrame]:
    """All that follows from evidence records, by name."""
    own = claims(records)
    found = findings(own)
    return {"claims": own, "members": claim_members(records), "findings": found, "candidates": candidates(found), "decisions": decide(own)}


def page_of(refs: DataFrame, bodies: DataFrame, after: int, size: int) -> DataFrame:
    """The next refs (id, checksum) by id with their bodies (id, body): OK, MISMATCH where a body's digest is another, MISSING where there is none. Only the page's rows reach the join."""
    page = refs.where(F.col("id") > after).orderBy("id").limit(size)
    digest = F.sha2("body", 256)
    status = F.when(F.col("body").isNull(), "MISSING").when(digest == F.col("checksum"), "OK").otherwise("MISMATCH")
    return page.join(bodies, "id", "left").select("id", status.alias("status"))


def checksum(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def idempotent(commands: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """key, first (by order), mismatch (the same key with different contents)."""
    return commands.groupBy(key).agg(F.min(order).alias("first"), (F.count_distinct(content) > 1).alias("mismatch"))


#: What a decision makes of an object, and the reasons it gives (fixed values). A disposition that isn't listed changes nothing.
DISPOSITIONS = {"KEEP": None, "EXCLUDED": "标准化决定 {} 将该对象排除。", "DEFERRED": "标准化决定 {} 延后该对象。", "CANDIDATE_ONLY": "标准化决定 {} 仅登记为候选。"}


def apply_decisions(exclusions: DataFrame, pending: DataFrame, rules: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is excluded and what is pending after decisions, taken in order.

    exclusions and pending (position, code, name, reason), rules (code), decisions (position, decision, kind, code, disposition, name),
    evidence (decision, code, ref) -> list (EXCLUSION or PENDING), place, code, name, reason, decision, refs; decision and refs (in
    order, comma-joined) of what a decision added, NULL for what was there.

    EXCLUDED adds an exclusion unless the code has one; DEFERRED and CANDIDATE_ONLY add a pending entry of the code
    `deferred:<kind>:<code>` or `candidate:<kind>:<code>` unless there is one, CANDIDATE_ONLY of a rule only if it isn't among the rules.
    KEEP takes away the first entry of each of the three codes.

    A list holds what was there and, once all of that is taken away, the first addition after the last removal: so counts and
    extremes by code decide, and no code's decisions are replayed in one task.
    """
    decided = decisions.join(rules.select("code", F.lit("RULE").alias("kind"), F.lit(True).alias("__rule")).distinct(), ["code", "kind"], "left")
    of = lambda prefix: F.concat(F.lit(f"{prefix}:"), "kind", F.lit(":"), "code")
    change = lambda where, list_, key, adds: F.when(where, F.struct(F.lit(list_).alias("list"), key.alias("key"), F.lit(adds).alias("adds")))
    is_ = lambda d: F.col("disposition") == d
    changes = F.array(
        change(is_("KEEP"), "EXCLUSION", F.col("code"), False), change(is_("KEEP"), "PENDING", of("deferred"), False), change(is_("KEEP"), "PENDING", of("candidate"), False),
        change(is_("EXCLUDED"), "EXCLUSION", F.col("code"), True), change(is_("DEFERRED"), "PENDING", of("deferred"), True), change(is_("CANDIDATE_ONLY") & F.col("__rule").isNull(), "PENDING", of("candidate"), True),
    )
    changed = decided.select("position", "decision", "code", "name", "disposition", F.explode(F.array_compact(changes)).alias("c")).select("*", "c.*").drop("c")
    there = exclusions.select(F.lit("EXCLUSION").alias("list"), "position", F.col("code").alias("key"), "name", "reason").unionByName(pending.select(F.lit("PENDING").alias("list"), "position", F.col("code").alias("key"), "name", "reason"))
    removals = changed.where("NOT adds").groupBy("list", "key").agg(F.count(F.lit(1)).alias("__removed"), F.max("position").alias("__last"))
    kept = over(there, ["list", "key"], ["position"], __nth=("row_number",)).join(removals, ["list", "key"], "left").where("__nth > coalesce(__removed, 0)")
    none = F.lit(None).cast("string")
    old = kept.select("list", F.struct(F.lit(0).alias("added"), F.col("position").cast("long").alias("position")).alias("place"), F.col("key").alias("code"), "name", "reason", none.alias("decision"), none.alias("refs"))
    later = changed.where("adds").join(removals, ["list", "key"], "left").where("__last IS NULL OR position > __last")
    first = later.groupBy("list", "key").agg(F.min_by(F.struct("position", "decision", "code", "name", "disposition"), "position").alias("f"))
    first = first.join(kept.select("list", "key").distinct(), ["list", "key"], "left_anti").select("list", "key", "f.*")
    refs = evidence.where("ref IS NOT NULL").groupBy("decision", "code").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))
    reason = F.coalesce(*[F.when(is_(d), F.concat(F.lit(text.split("{}")[0]), "decision", F.lit(text.split("{}")[1]))) for d, text in DISPOSITIONS.items() if text])
    new = first.join(refs, ["decision", "code"], "left").select(
        "list", F.struct(F.lit(1).alias("added"), F.col("position").cast("long").alias("position")).alias("place"), F.col("key").alias("code"), "name", reason.alias("reason"), "decision", F.coalesce("refs", F.lit("")).alias("refs")
    )
    return old.unionByName(new)


def eligibility(candidates_: DataFrame, exclusions: DataFrame, pending: DataFrame) -> DataFrame:
    """What may be modelled: candidates (candidate, kind, code, name, summary), exclusions and pending (place, code, name, reason) -> conclusion, candidate, name, eligibility, reason.

    A candidate whose code is excluded is EXCLUDED_GAP; one whose code is pending (as it is, or behind `deferred:<kind>:` or
    `candidate:<kind>:`), or of the kind PENDING_ASSET with a summary, EXCLUDED_UNCERTAIN; else ELIGIBLE. Of several
    entries of a code the last one counts, and without a reason it excludes nothing. An exclusion whose code no candidate has gets
    a row of its own without a candidate. A candidate without a code is matched by nothing.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    behind = F.nullif(F.regexp_extract("code", "^(?:deferred|candidate):[^:]+:(.+)$", 1), F.lit(""))
    gaps = exclusions.groupBy(given("code").alias("__code")).agg(F.max_by("reason", "place").alias("__gap"))
    doubts = pending.groupBy(F.coalesce(behind, given("code")).alias("__code")).agg(F.max_by("reason", "place").alias("__doubt"))
    coded = candidates_.withColumn("__code", given("code"))
    joined = coded.join(gaps, "__code", "left").join(doubts, "__code", "left")
    gap = given("__gap")
    doubt = F.when(F.col("kind") == "PENDING_ASSET", given("summary")).otherwise(given("__doubt"))
    status = F.when(gap.isNotNull(), "EXCLUDED_GAP").when(doubt.isNotNull(), "EXCLUDED_UNCERTAIN").otherwise("ELIGIBLE")
    own = joined.select(F.concat(F.lit("conclusion:"), "candidate").alias("conclusion"), "candidate", "name", status.alias("eligibility"), F.coalesce(gap, doubt).alias("reason"))
    alone = exclusions.withColumn("__code", given("code")).join(coded.select("__code").where("__code IS NOT NULL").distinct(), "__code", "left_anti")
    return own.unionByName(alone.select(F.concat(F.lit("conclusion:gap:"), "code").alias("conclusion"), F.lit(None).cast(own.schema["candidate"].dataType).alias("candidate"), "name", F.lit("EXCLUDED_GAP").alias("eligibility"), "reason"))


def unclosed(sources: DataFrame, evidence: DataFrame, claims_: DataFrame) -> DataFrame:
    """sources (connection, snapshot, upstream: array of snapshots), evidence (id), claims (claim, source, refs: array, upstream: array of claims) -> code, claim of what a frozen set refers to and doesn't hold.

    OPEN_UPSTREAM: a claim stands on one whose source's snapshot isn't upstream of its own source. NULL refers to nothing there.
    """
    code = lambda df, name: df.select(F.lit(name).alias("code"), "claim")
    refs = claims_.select("claim", F.explode("refs").alias("id"))
    ups = claims_.select("claim", "source", F.explode("upstream").alias("__up"))
    at = ups.join(claims_.select(F.col("claim").alias("__up"), F.col("source").alias("__up_source")).distinct(), "__up")
    upper = sources.select(F.col("connection").alias("__up_source"), F.col("snapshot").alias("__snapshot"))
    closed = sources.select(F.col("connection").alias("source"), F.explode("upstream").alias("__snapshot")).distinct()
    wanted = at.join(upper, "__up_source")
    found = [
        code(claims_.join(sources.select(F.col("connection").alias("source")), "source", "left_anti"), "MISSING_SOURCE"),
        code(refs.join(evidence.select("id"), "id", "left_anti"), "MISSING_EVIDENCE"),
        code(ups.join(claims_.select(F.col("claim").alias("__up")), "__up", "left_anti"), "MISSING_UPSTREAM"),
        code(wanted.join(closed, ["source", "__snapshot"], "left_anti"), "OPEN_UPSTREAM"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def verify_batches(items: DataFrame, bodies: DataFrame, size: int = 100, verified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """items (position, ref, checksum; position unique), bodies (ref, body) -> progress and what is verified.

    progress (batch from 1, status, n_items, n_completed, failed) says how far a check in order comes: the first item whose body is
    missing or has another digest stops it; its batch is FAILED, the ones before it COMPLETED, those after it NOT_RUN. The second
    frame (ref, checksum) has the items that were read and found good, also behind the stop. Those that `verified` has, from
    runs before, are good unread.
    All digests are taken in one job, so what follows a stop is verified too; counts of the batches give the progress, and one number reaches the driver.
    """
    placed = places(items.select("position", "ref", "checksum"), ["position"])
    before = (verified if verified is not None else items.limit(0)).select("ref", "checksum", F.lit(True).alias("__known")).distinct()
    marked = placed.join(before, ["ref", "checksum"], "left")
    unread = marked.where("__known IS NULL").join(bodies.select("ref", "body"), "ref", "left").select("place", "ref", "checksum", F.coalesce(F.sha2("body", 256) == F.col("checksum"), F.lit(False)).alias("good"))
    read = unread.withColumn("read", F.lit(True))
    checked = materialize(read.unionByName(marked.where("__known").select("place", "ref", "checksum", F.lit(True).alias("good"), F.lit(False).alias("read"))), "verified")
    bad = F.when(~F.col("good"), F.struct("place", "ref"))
    stop = checked.agg(F.min(bad).alias("bad")).first()["bad"]
    batch = (F.floor((F.col("place") - 1) / size) + 1).cast("long")
    at = None if stop is None else stop["place"]
    status = F.lit("COMPLETED") if at is None else F.when(F.col("batch") <= (at - 1) // size, "COMPLETED").when(F.col("batch") == (at - 1) // size + 1, "FAILED").otherwise("NOT_RUN")
    good = F.lit(True) if at is None else F.col("place") < at
    failed = F.when(status == "FAILED", F.lit(None if stop is None else stop["ref"]))
    progress = checked.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(good).alias("n_completed")).select("batch", status.alias("status"), "n_items", "n_completed", failed.alias("failed"))
    return progress, checked.where("good AND read").select("ref", "checksum")
