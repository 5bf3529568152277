"""Windows over ranges against Spark's own, and how a key with all rows is spread."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.operators import joins, ranged


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("keys", [[None, 1, 1, 1, 1, 2, 3], [5]])
def test_like_windows(spark, many_ranges, keys):
    rng = random.Random(len(keys))
    df = spark.createDataFrame([(rng.choice(keys), rng.choice([None, *range(40)]), i, rng.choice([None, 1.5, 2.5, 4.0])) for i in range(300)], "k int, o int, i int, v double")
    got = ranged.over(
        df, ["k"], ["o", "i"], rn=("row_number",), q=("ntile", 7), n=("total",), s=("sum", "v"), c=("count", "v"), l=("last", "v"), b=("last_before", "v"), g=("lag", "v"), d=("lead", "v"), f=("first", "v")
    )
    w = W.partitionBy("k").orderBy("o", "i")
    here, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select(
        "*", F.row_number().over(w).alias("rn"), F.ntile(7).over(w).alias("q"), F.count(F.lit(1)).over(W.partitionBy("k")).alias("n"), F.sum("v").over(here).alias("s"), F.count("v").over(here).alias("c"),
        F.last("v", True).over(here).alias("l"), F.last("v", True).over(before).alias("b"), F.lag("v").over(w).alias("g"), F.lead("v").over(w).alias("d"), F.first("v").over(w).alias("f"),
    )
    same(got, want)
    w = W.partitionBy("k").orderBy("o")
    same(ranged.over(df, ["k"], ["o"], r=("rank",), d=("dense_rank",)), df.select("*", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d")))


def test_small_tables(spark):
    none = spark.createDataFrame([], "k int, o int")
    assert ranged.over(none, ["k"], ["o"], rn=("row_number",), g=("lag", "o")).collect() == []
    one = spark.createDataFrame([(None, None)], "k int, o int")
    assert [tuple(r) for r in ranged.over(one, ["k"], ["o"], rn=("row_number",), q=("ntile", 3), g=("lag", "o"), s=("sum", "o")).collect()] == [(None, None, 1, 1, None, None)]
    whole = spark.createDataFrame([(3,), (1,), (2,)], "o int")
    assert {r.o: r.rn for r in ranged.over(whole, [], ["o"], rn=("row_number",)).collect()} == {1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError):
        ranged.over(one, ["k"], ["o"], x=("median", "o"))


def test_one_key_is_spread_over_all_tasks(spark, many_ranges):
    df = spark.range(40_000).select(F.lit(7).alias("k"), F.col("id").alias("o"))
    out = ranged.over(df, ["k"], ["o"], rn=("row_number",), before=("lag", "o"))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 25_000
    written = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    ranges = [r["count"] for r in written.groupBy("__range").count().collect()]
    assert len(ranges) == 4 and max(ranges) < 15_000
    assert out.where("rn <> o + 1 OR coalesce(before, -1) <> o - 1").count() == 0


def test_as_of_with_one_group(spark, many_ranges):
    rng = random.Random(3)
    day = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *map(day, range(300))])) for i in range(400)]
    times = {(g, t) for g in (1, 1, 1, 3) for t in [day(rng.randrange(300)) for _ in range(60)]} | {(1, None)}
    right = [(g, t, n if n % 5 else None) for n, (g, t) in enumerate(sorted(times, key=repr))]
    out = joins.as_of_sorted(spark.createDataFrame(left, "i int, g int, t timestamp"), spark.createDataFrame(right, "g int, f timestamp, v int"), "g", "t", "f", ["f", "v"])

    def latest(g, t):
        rows = [(f, v) for h, f, v in right if h == g and f is not None and t is not None and f <= t]
        return max(rows, key=lambda r: r[0], default=(None, None))

    assert sorted((r.i, r.f, r.v) for r in out.collect()) == sorted((i, *latest(g, t)) for i, g, t in left)
