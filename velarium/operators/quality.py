"""Data-quality checks: each gives the rows that break it, as (code, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "code string, key string, detail string"


def _out(df: DataFrame, code: str, key: str | Column, detail: str | Column) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(F.lit(code).alias("code"), text(key).alias("key"), text(detail).alias("detail"))


def duplicates(df: DataFrame, code: str, key: str) -> DataFrame:
    """Keys that are there more than once, and how often."""
    return _out(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), code, key, "__n")


def ambiguous(df: DataFrame, code: str, key: str, target: str) -> DataFrame:
    """Keys with several targets, and how many."""
    return _out(df.groupBy(key).agg(F.count_distinct(target).alias("__n")).where("__n > 1"), code, key, "__n")


def missing(df: DataFrame, code: str, key: str, *columns: str) -> DataFrame:
    """Rows that lack a required value, and which; an empty text counts as none."""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in columns]))
    return _out(df.withColumn("__m", absent).where(F.size("__m") > 0), code, key, F.array_join("__m", ","))


def dangling(df: DataFrame, code: str, key: str, reference: str, target: DataFrame, target_key: str) -> DataFrame:
    """References that lead nowhere."""
    known = target.select(F.col(target_key).alias("__k")).distinct()
    return _out(df.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("__k"), "left_anti"), code, key, reference)


def in_use(df: DataFrame, code: str, key: str, users: DataFrame, reference: str) -> DataFrame:
    """Rows that can't be deleted, since others refer to them."""
    return _out(df.join(users.groupBy(F.col(reference).alias("__r")).agg(F.count(F.lit(1)).alias("__n")), F.col(key) == F.col("__r")), code, key, "__n")


def failing(df: DataFrame, code: str, key: str, bad: Column, detail: str | Column) -> DataFrame:
    """Rows where a condition holds that must not."""
    return _out(df.where(bad), code, key, detail)


def gate(violations: DataFrame, blockers: tuple[str, ...]) -> DataFrame:
    """One row: how many violations block, how many warn, and whether all may be published."""
    blocking = F.col("code").isin(*blockers)
    return violations.agg(F.count_if(blocking).alias("n_blockers"), F.count_if(~blocking).alias("n_warnings"), (F.count_if(blocking) == 0).alias("publishable"))
