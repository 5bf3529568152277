"""Global places and exact medians without a task that holds a whole group.

Rows are dealt into ranges of the whole order and written once; counts of the ranges, which are as many as
partitions, give each range its offset, and ranks are taken inside ranges only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.session import materialize


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of its order, written: a second run could draw other bounds."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def _before(*keys: str):
    return F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def places(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place from 1 in an order whose columns are unique together."""
    rows = _ranged(df, *order)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", _before().alias("__before"))  # a row for each range
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return rows.withColumn("__k", inside).join(F.broadcast(sizes), "__range").withColumn(name, F.col("__before") + F.col("__k")).drop("__range", "__k", "__before")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, and the exact median of each group's values; groups without a value have no row."""
    names = [f"__k{n}" for n in range(len(keys))] or ["__k0"]
    held = [F.col(k) for k in keys] or [F.lit(0)]
    rows = df.where(F.col(value).isNotNull()).select(*[k.alias(n) for k, n in zip(held, names, strict=True)], F.col(value).alias("__v"))
    rows = _ranged(rows, *names, "__v")
    sizes = rows.groupBy(*names, "__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range that a group is in
    total = F.sum("__n").over(W.partitionBy(*names))
    sizes = sizes.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__range").alias("__r"), _before(*names).alias("__before"), "__n", total.alias("__total"))
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    # Only the one or two ranges that hold a group's middle are ranked.
    middle = sizes.where((F.col("__before") < high) & (F.col("__before") + F.col("__n") >= low))
    same = F.col("__range") == F.col("__r")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    found = rows.join(middle, same).withColumn("__k", F.row_number().over(W.partitionBy(*names, "__range").orderBy("__v")) + F.col("__before"))
    out = found.where((F.col("__k") == low) | (F.col("__k") == high)).groupBy(*names).agg(F.avg(F.col("__v").cast("double")).alias(name))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=False)], name)
