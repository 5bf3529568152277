"""Who may change what, and in which order changes go through: optimistic locks, and review and publication by two people.

Both are sequential by nature: each change goes through or not by the state that the ones before it left. As a revision
is reached once only, the changes that go through are a chain, each with one successor; links come from joins and
aggregates, the chain from hops that double (`fixpoint.trail`), and no key's changes meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.operators import ranged
from velarium.operators.fixpoint import trail
from velarium.session import materialize

#: Roles that may review and publish (fixed values).
REVIEWERS, PUBLISHERS = ("REVIEWER", "ADMIN"), ("PUBLISHER", "ADMIN")
#: A reason has to have a Han character (fixed value).
REASON = r"[\u3400-\u9fff]"


def guarded_writes(writes: DataFrame, key: str, order: str, expected: str, initial: int = 1) -> DataFrame:
    """writes with outcome, revision: a write is APPLIED if the key's revision is the one it expects, and adds one to it; else STALE.

    order is a number, unique within a key; revision is the key's after the write. A write that expects NULL is STALE.
    A write's successor is the first one after it that expects the next revision.
    """
    w = materialize(writes.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(expected).cast("long").alias("e")).where("e IS NOT NULL"), "writes")
    node = F.struct("k", "o")
    ends = w.select("k", F.col("e").alias("level"), (-F.col("o")).alias("back"), F.col("o").alias("to"), F.lit(None).cast(w.schema["o"].dataType).alias("of"))
    ways = w.select("k", (F.col("e") + 1).alias("level"), (-F.col("o")).alias("back"), F.lit(None).cast(w.schema["o"].dataType).alias("to"), F.col("o").alias("of"))
    # From the last write to the first, the last end passed is the next one in time.
    met = ranged.over(ends.unionByName(ways), ["k", "level"], ["back"], next=("last_before", "to")).where("of IS NOT NULL AND next IS NOT NULL")
    links = met.select(F.struct("k", F.col("of").alias("o")).alias("a"), F.struct("k", F.col("next").alias("o")).alias("b"))
    starts = w.where(F.col("e") == initial).groupBy("k").agg(F.min("o").alias("o")).select(node.alias("node"))
    applied = trail(links, starts).select(F.col("node.k").alias(key), F.col("node.o").alias(order), F.lit(1).alias("__applied"))
    found = writes.join(applied.hint("merge"), [key, order], "left")
    counted = ranged.over(found, [key], [order], __done=("count", "__applied"))
    outcome = F.when(F.col("__applied") == 1, "APPLIED").otherwise("STALE")
    return counted.select(*[c for c in writes.columns if c not in ("outcome", "revision")], outcome.alias("outcome"), (F.col("__done") + initial).alias("revision"))


def review_and_publish(requests: DataFrame, actions: DataFrame, roles: DataFrame) -> DataFrame:
    """requests (request, space, author, base), actions (request, seq, actor, action, decision, expected, reason), roles (space, actor, role) -> request, seq, outcome, version.

    seq orders the actions of a space. Actions are REVIEW (with a decision) and PUBLISH. The first thing that is wrong is the
    outcome: NOT_OPEN or NOT_APPROVED by the request's status then, SELF where the author acts, FORBIDDEN by role, STALE
    where the revision expected isn't the request's (1 before its review, 2 after it), NO_REASON. Else a review makes its
    decision, and a publication is PUBLISHED with the space's next version if the request's base (a request, or NULL
    for none) was the last one published then; if not, CONFLICTED, and the request can't be published any more.
    An action of an unknown request has no row. Joins by request ask for sorted ranges, so that no side goes through the driver.
    """
    may = roles.groupBy("space", "actor").agg(F.bool_or(F.col("role").isin(*REVIEWERS)).alias("__reviews"), F.bool_or(F.col("role").isin(*PUBLISHERS)).alias("__publishes"))
    acted = actions.join(requests.hint("merge"), "request").join(may, ["space", "actor"], "left")
    publishes = F.col("action") == "PUBLISH"
    allowed = F.coalesce(F.when(publishes, F.col("__publishes")).otherwise(F.col("__reviews")), F.lit(False))
    explained = F.coalesce(F.col("reason").rlike(REASON), F.lit(False)) | (~publishes & (F.col("decision") == "APPROVE"))
    wrong = (
        F.when(F.col("author").eqNullSafe(F.col("actor")), "SELF")
        .when(~allowed, "FORBIDDEN")
        .when(~F.col("expected").eqNullSafe(F.when(publishes, 2).otherwise(1)), "STALE")
        .when(~explained, "NO_REASON")
    )
    decided = F.when(F.col("decision") == "APPROVE", "APPROVED").when(F.col("decision") == "REJECT", "REJECTED").otherwise("CHANGES_REQUESTED")
    acts = materialize(acted.select("request", "space", "base", "seq", "action", wrong.alias("wrong"), decided.alias("decided")), "actions")
    review = acts.where("action = 'REVIEW' AND wrong IS NULL").groupBy("request").agg(F.min("seq").alias("__decided_at"), F.min_by("decided", "seq").alias("__status"))
    first = acts.where("action = 'PUBLISH' AND wrong IS NULL").join(review.where("__status = 'APPROVED'").hint("merge"), "request").where("seq > __decided_at")
    tried = materialize(first.groupBy("request").agg(F.min("seq").alias("at"), F.min_by("space", "seq").alias("space"), F.min_by("base", "seq").alias("base")), "publications")
    earliest = F.min_by("request", F.struct("at", "request"))
    on = tried.select(F.col("request").alias("base"), F.col("space").alias("__space"), F.col("at").alias("__at"))
    links = tried.join(on.hint("merge"), "base").where((F.col("space") == F.col("__space")) & (F.col("at") > F.col("__at"))).groupBy("base").agg(earliest.alias("b")).select(F.col("base").alias("a"), "b")
    starts = tried.where("base IS NULL").groupBy("space").agg(earliest.alias("node")).select("node")
    published = trail(links, starts).select(F.col("node").alias("request"), (F.col("steps") + 1).alias("__version"))
    known = acts.join(review.hint("merge"), "request", "left").join(tried.select("request", F.col("at").alias("__tried_at")).hint("merge"), "request", "left").join(published.hint("merge"), "request", "left")
    open_ = F.coalesce(F.col("seq") <= F.col("__decided_at"), F.lit(True))
    approved = F.coalesce((F.col("__status") == "APPROVED") & (F.col("seq") > F.col("__decided_at")), F.lit(False)) & F.coalesce(F.col("seq") <= F.col("__tried_at"), F.lit(True))
    is_publish = F.col("action") == "PUBLISH"
    goes = is_publish & approved & F.col("wrong").isNull() & F.col("__version").isNotNull()
    outcome = (
        F.when(is_publish & ~approved, "NOT_APPROVED")
        .when(~is_publish & ~open_, "NOT_OPEN")
        .when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when(~is_publish, F.col("decided"))
        .when(goes, "PUBLISHED")
        .otherwise("CONFLICTED")
    )
    return known.select("request", "seq", outcome.alias("outcome"), F.when(goes, F.col("__version")).alias("version"))
