"""Joins that Spark has no operator for, without pairing what can't match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.operators import ranged
from velarium.operators.intervals import contained, overlaps  # noqa: F401  part of this module's functions
from velarium.session import materialize


#: Pairs of a key that many_to_many leaves to one task.
PART_PAIRS = 5_000_000


def many_to_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right by an equal key that may have many rows on both sides: by the number of its pairs, a key is dealt into parts of left, each of which meets all of its right rows."""
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("__m")), key)
    parts = F.least(F.ceil(F.col("__n") * F.col("__m") / PART_PAIRS), F.col("__n"))
    hot = materialize(sizes.where(F.col("__n") * F.col("__m") > PART_PAIRS).select(key, parts.cast("int").alias("__parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    deal = F.pmod(F.xxhash64(*left.columns), F.coalesce("__parts", F.lit(1))).cast("int")
    a = left.join(hot, key, "left").withColumn("__part", deal).drop("__parts")
    b = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    # By number: rows are few for the pairs they make, and small shuffles would be merged into few tasks.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (rows.repartition(tasks, key, "__part") for rows in (a, b))
    return a.join(b.hint("merge"), [key, "__part"]).drop("__part")


def diff(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: ADDED, REMOVED, MODIFIED or UNCHANGED. NULL equals NULL."""
    values = [c for c in base.columns if c not in keys]
    old, fresh = base.select(*keys, F.struct(*values).alias("__old")), new.select(*keys, F.struct(*values).alias("__new"))
    change = F.when(F.col("__old").isNull(), "ADDED").when(F.col("__new").isNull(), "REMOVED").when(~F.col("__old").eqNullSafe(F.col("__new")), "MODIFIED").otherwise("UNCHANGED")
    return old.join(fresh, keys, "full_outer").select(*keys, change.alias("change"))


def diff_fields(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, field, before, after of each field that differs in rows that both have; values as text."""
    fields = [c for c in base.columns if c != key]
    both = base.alias("o").join(new.alias("n"), key)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("before"), F.col(f"n.{f}").cast("string").alias("after")) for f in fields])
    return both.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where(~F.col("before").eqNullSafe(F.col("after")))


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, effective: str, values: list[str]) -> DataFrame:
    """left with the values of right's latest row of the group that is in effect; NULL before the first.

    For a right side with few rows a group (targets, rates, versions): each row holds until the next, and
    the hash join by group tests those intervals. Work grows with the right rows of a group, but a group
    that holds most of left is split over tasks by the skew handling. For long right sides use as_of_sorted.
    """
    ahead = W.partitionBy(group).orderBy(effective)
    spans = right.withColumn("__until", F.lead(effective).over(ahead)).select(group, *values, F.col(effective).alias("__from"), "__until")
    on = (left[group] == spans[group]) & (left[at] >= F.col("__from")) & (F.col("__until").isNull() | (left[at] < F.col("__until")))
    return left.join(spans, on, "left").select(*[left[c] for c in left.columns], *values)


def as_of_sorted(left: DataFrame, right: DataFrame, group: str, at: str, effective: str, values: list[str]) -> DataFrame:
    """as_of() for groups with many rows on either side: both sides in one order of group and time, each row takes the last values that it passes. Time is linear in both sides, and a group is spread over ranges of that order."""
    return ranged.as_of(left, right, group, at, effective, values)


def classify(wanted: DataFrame, have: DataFrame, key: str, other: str) -> DataFrame:
    """wanted with outcome: UNIQUE, MULTIPLE or NO_MATCH (UNRESOLVED where the key is NULL)."""
    counts = have.groupBy(F.col(other).alias(key)).agg(F.count(F.lit(1)).alias("__n"))
    outcome = F.when(F.col(key).isNull(), "UNRESOLVED").when(F.col("__n").isNull(), "NO_MATCH").when(F.col("__n") == 1, "UNIQUE").otherwise("MULTIPLE")
    return wanted.join(counts, key, "left").withColumn("outcome", outcome).drop("__n")


def map_prefixes(df: DataFrame, column: str, mappings: list[tuple[str, str]]) -> DataFrame:
    """df with route (prefix stripped, replacement added; NULL unless one mapping applies) and n_mappings. mappings: a short list, compiled into the plan."""
    hits = [F.col(column).startswith(prefix) for prefix, _ in mappings]
    count = reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(False)).cast("long") for h in hits])
    route = F.lit(None).cast("string")
    for hit, (prefix, add) in zip(hits, mappings, strict=True):
        route = F.when(hit, F.concat(F.lit(add), F.substring(F.col(column), len(prefix) + 1, 1 << 30))).otherwise(route)
    return df.withColumn("n_mappings", count).withColumn("route", F.when(count == 1, route))


def divide(df: DataFrame, key: str, value: str, required: DataFrame) -> DataFrame:
    """Keys that have every required value."""
    needed = required.agg(F.count_distinct(value).alias("__needed"))
    have = df.join(required.select(value), value, "left_semi").groupBy(key).agg(F.count_distinct(value).alias("__have"))
    return have.join(F.broadcast(needed), F.col("__have") == F.col("__needed")).select(key)  # one row


def bind_parameters(tokens: DataFrame, parameters: DataFrame) -> DataFrame:
    """tokens (token_id, statement, token as `#{root.rest}`), parameters (statement, name, alias) -> token_id, root, n_parameters: how many parameters of its statement a token's root names (none: unbound, several: ambiguous)."""
    known = parameters.select("statement", F.coalesce("alias", "name").alias("root"), F.struct("name", "alias").alias("p")).groupBy("statement", "root").agg(F.count_distinct("p").alias("n"))
    rows = tokens.withColumn("root", F.regexp_extract("token", r"\{([^.}]+)", 1))
    return rows.join(known, ["statement", "root"], "left").select("token_id", "root", F.coalesce("n", F.lit(0)).cast("long").alias("n_parameters"))


def require(df: DataFrame, reference: str, target: DataFrame, key: str) -> DataFrame:
    """df with target's columns by an equal key; a reference that leads nowhere fails the query when it runs."""
    known = target.withColumn("__there", F.lit(True))
    joined = df.join(known, df[reference] == known[key], "left")
    missing = F.raise_error(F.concat(F.lit(f"{reference} leads nowhere: "), df[reference].cast("string")))
    return joined.withColumn("__there", F.when(F.col("__there") | df[reference].isNull(), True).otherwise(missing.cast("boolean"))).where("__there").drop("__there")
