"""Interval joins of mixed lengths against all pairs, and how buckets and copies are bounded."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from velarium.operators import intervals


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.randrange(-4000, 4000)
        out.append((k, rng.choice(["m", "m", "m", "n", None]), start, start + rng.choice([-5, 0, 1, 6, 7, 8, 30, 365, 3650, 100_000])))
    return [*out, (n, "m", None, 5), (n + 1, "m", 5, None)]


def holds(s, e):
    return s is not None and e is not None and s <= e


@pytest.mark.parametrize("part_rows", [50_000, 4])
def test_overlaps(spark, monkeypatch, part_rows):
    monkeypatch.setattr(intervals, "PART_ROWS", part_rows)
    rows = spans(1, 150)
    got = [tuple(r) for r in intervals.overlaps(spark.createDataFrame(rows, "k int, g string, s long, e long"), "k", "g", "s", "e").collect()]
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and holds(*a[2:]) and holds(*b[2:]) and a[2] <= b[3] and a[3] >= b[2]]
    assert sorted(got) == want


@pytest.mark.parametrize("part_rows", [50_000, 4])
def test_contained(spark, monkeypatch, part_rows):
    monkeypatch.setattr(intervals, "PART_ROWS", part_rows)
    rows = spans(2, 100)
    rng = random.Random(3)
    dots = [(i, rng.choice(["m", "n", None]), rng.choice([None, *range(-4100, 4100, 7)])) for i in range(120)] * 2
    got = [(r.i, r.k) for r in intervals.contained(spark.createDataFrame(dots, "i int, g string, p long"), spark.createDataFrame(rows, "k int, g string, s long, e long"), "g", "p", "s", "e").collect()]
    assert sorted(got) == sorted((i, k) for i, g, p in dots for k, h, s, e in rows if g and g == h and p is not None and holds(s, e) and s <= p <= e)


@pytest.mark.parametrize(("few", "copies"), [(64, 1), (30, None), (0, None)])
def test_points_of_few_intervals_have_no_copies(spark, monkeypatch, few, copies):
    """Groups with few intervals, with many, and both: the same pairs; a point goes through the shuffle once where its group has few."""
    monkeypatch.setattr(intervals, "FEW", few)
    rows = [(k, "m" if k % 3 else "n", k * 10, k * 10 + 2 ** (k % 9)) for k in range(60)]
    dots = [(i, "mn"[i % 2], i * 3) for i in range(200)]
    sides = []
    meet = intervals.meet
    monkeypatch.setattr(intervals, "meet", lambda own, *rest: sides.append(own.count()) or meet(own, *rest))
    got = [(r.i, r.k) for r in intervals.contained(spark.createDataFrame(dots, "i int, g string, p long"), spark.createDataFrame(rows, "k int, g string, s long, e long"), "g", "p", "s", "e").collect()]
    assert sorted(got) == sorted((i, k) for i, g, p in dots for k, h, s, e in rows if g == h and s <= p <= e)
    if copies:
        assert sides == [len(dots)]


def test_dates_and_times(spark):
    rows = [(1, "m", date(1969, 12, 30), date(1970, 1, 2)), (2, "m", date(1970, 1, 2), date(1970, 1, 2)), (3, "m", date(1970, 1, 3), date(1980, 1, 1))]
    df = spark.createDataFrame(rows, "k int, g string, s date, e date")
    assert [tuple(r) for r in intervals.overlaps(df, "k", "g", "s", "e").collect()] == [(1, 2)]
    at = datetime(2024, 1, 1, 12)
    times = spark.createDataFrame([(1, "m", at, at + timedelta(seconds=1)), (2, "m", at + timedelta(microseconds=1_000_000), at + timedelta(days=900)), (3, "m", at - timedelta(days=1), at - timedelta(microseconds=1))], "k int, g string, s timestamp, e timestamp")
    assert [tuple(r) for r in intervals.overlaps(times, "k", "g", "s", "e").collect()] == [(1, 2)]
    none = df.where("k > 9")
    assert intervals.overlaps(none, "k", "g", "s", "e").count() == 0 and intervals.contained(df.select("g", "s"), none, "g", "s", "s", "e").count() == 0


def test_copies_grow_with_the_logarithm(spark):
    """An interval of any length has two copies at each level at most."""
    rows = spark.createDataFrame([(k, "m", 17, 17 + 2**k) for k in range(40)], "k int, g string, s long, e long")
    leveled = intervals._leveled(rows, "g", "s", "e")
    filed = intervals._filed(leveled.withColumn("__at", F.explode(F.filter(intervals._levels(leveled), lambda x: x >= F.col("__level")))))
    assert filed.groupBy("k", "__at").count().agg(F.max("count")).first()[0] <= 2
    assert filed.where("k = 0").count() <= 2 * 41


def test_a_hot_bucket_is_dealt(spark, monkeypatch):
    """One group and one day with all intervals: no part has more than a few of its own side."""
    monkeypatch.setattr(intervals, "PART_ROWS", 100)
    own = spark.range(1000).select(F.col("id").alias("k"), F.lit("m").alias("g"))
    met = intervals.meet(own, spark.createDataFrame([("m", 1), ("m", 2)], "g string, v int"), ["g"], "k")
    assert met.count() == 2000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "__part" in plan
    parts = own.select(F.pmod(F.xxhash64("k"), F.lit(10)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert parts < 200
