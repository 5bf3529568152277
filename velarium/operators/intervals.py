"""Interval joins for intervals of any length.

An interval has a level by its length: the least power of two above it is the width of that level's buckets, so it
lies in two of them at most. It is filed there, and at each wider level that any interval has, so its copies are
as many as the logarithm of the longest length at most. Two intervals meet at the level of the longer one, in the first bucket
that they share there; a point is looked up in one bucket of each level. Nearly all that meets in a bucket does
overlap, so the work is that of the result, however lengths are mixed.

Points of a group with few intervals are not looked up by levels, which takes a copy of the point for each: they meet
all intervals of their group.

Buckets in which very many intervals have their level are dealt into parts, each of which meets a copy of the other side.

Ends are dates, times or whole numbers, and belong to the interval. Intervals with a NULL end, a NULL group, or whose
end comes before their start hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.session import materialize

#: Rows of a key that are one part.
PART_ROWS = 50_000
#: Up to so many hot keys go to every task; more are joined by a shuffle.
BROADCAST_KEYS = 10_000
#: Points of groups with at most so many intervals meet all of these.
FEW = 64


def number(df: DataFrame, column: str) -> Column:
    """A date as its day, a time as its microsecond, a whole number as it is."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "date":
        return F.unix_date(column).cast("long")
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column).cast("long")


def meet(own: DataFrame, other: DataFrame, keys: list[str], deal: str) -> DataFrame:
    """Rows of both sides with equal keys. A key with many rows of its own side is dealt into parts by `deal`, and each part meets the other side's rows."""
    hot = materialize(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PART_ROWS).select(*keys, F.ceil(F.col("__n") / PART_ROWS).alias("__parts")), "hot")
    n = hot.count()
    if not n:
        return own.join(other, keys)
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    parts = F.coalesce("__parts", F.lit(1))
    a = own.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(deal), parts)).drop("__parts")
    b = other.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"]).drop("__part")


def _leveled(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows with __s, __e as numbers, and __level."""
    rows = df.withColumn("__s", number(df, start)).withColumn("__e", number(df, end)).where(F.col(group).isNotNull() & (F.col("__e") >= F.col("__s")))
    length = F.col("__e") - F.col("__s")
    return rows.withColumn("__level", F.when(length == 0, 0).otherwise(F.length(F.bin(length))))


def _bucket(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _levels(rows: DataFrame) -> Column:
    """The levels there are, as a literal: 64 at most."""
    found = sorted(r[0] for r in rows.select("__level").distinct().collect())
    return F.array(*[F.lit(x) for x in found]) if found else F.array().cast("array<int>")


def _filed(rows: DataFrame) -> DataFrame:
    """A row for each bucket (__at, __b) that an interval's ends lie in, and those between: two at its own level."""
    return rows.withColumn("__b", F.explode(F.sequence(_bucket(F.col("__s"), F.col("__at")), _bucket(F.col("__e"), F.col("__at")))))


def overlaps(df: DataFrame, key: str, group: str, start: str, end: str) -> DataFrame:
    """Pairs (a, b; a before b) of keys of one group whose intervals overlap, each once. Keys are distinct."""
    rows = _leveled(df.select(key, group, start, end), group, start, end).select(F.col(key).alias("__k"), F.col(group).alias("__g"), "__s", "__e", "__level")
    levels = _levels(rows)
    own = _filed(rows.withColumn("__at", F.col("__level"))).drop("__level")
    every = _filed(rows.withColumn("__at", F.explode(F.filter(levels, lambda x: x >= F.col("__level")))))
    other = every.select(F.col("__k").alias("__k2"), "__g", F.col("__s").alias("__s2"), F.col("__e").alias("__e2"), F.col("__level").alias("__level2"), "__at", "__b")
    met = meet(own, other, ["__g", "__at", "__b"], "__k")
    once = (F.col("__level2") < F.col("__at")) | (F.col("__k") < F.col("__k2"))
    first = _bucket(F.greatest("__s", "__s2"), F.col("__at")) == F.col("__b")
    found = met.where(once & first & (F.col("__s") <= F.col("__e2")) & (F.col("__e") >= F.col("__s2")))
    return found.select(F.least("__k", "__k2").alias("a"), F.greatest("__k", "__k2").alias("b"))


def contained(points: DataFrame, intervals: DataFrame, group: str, at: str, start: str, end: str) -> DataFrame:
    """Rows of points with the columns of the intervals of their group that hold them."""
    rows = _leveled(intervals, group, start, end).select(F.col(group).alias("__g"), F.struct(*[F.col(c) for c in intervals.columns]).alias("__i"), "__s", "__e", "__level")
    dots = points.select(F.col(group).alias("__g"), F.struct(*[F.col(c) for c in points.columns]).alias("__dot"), number(points, at).alias("__p")).where("__p IS NOT NULL AND __g IS NOT NULL")
    # The side that crowds in one bucket is dealt; by what it holds, so that a task that runs again deals alike.
    dots = dots.withColumn("__deal", F.xxhash64(F.to_json("__dot")))
    crowded = materialize(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > FEW).select("__g"), "crowded")
    n = crowded.count()
    if not n:
        met = meet(dots, rows, ["__g"], "__deal")
    else:
        crowded = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded
        of = lambda df, how: df.join(crowded, "__g", how)
        many = of(rows, "left_semi")
        levels = _levels(many)
        own = _filed(many.withColumn("__at", F.col("__level")))
        each = of(dots, "left_semi").withColumn("__at", F.explode(levels)).withColumn("__b", _bucket(F.col("__p"), F.col("__at")))
        few = meet(of(dots, "left_anti"), of(rows, "left_anti"), ["__g"], "__deal")
        names = ["__dot", "__p", "__i", "__s", "__e"]
        met = few.select(*names).unionByName(meet(each, own, ["__g", "__at", "__b"], "__deal").select(*names))
    kept = [F.col("__i")[c].alias(c) for c in intervals.columns if c != group]
    return met.where(F.col("__p").between(F.col("__s"), F.col("__e"))).select(*[F.col("__dot")[c].alias(c) for c in points.columns], *kept)
