"""Window functions for keys of any size: what is one task in a window by key is spread over ranges here.

Rows are dealt into ranges of the order of keys and order together and written once, so that a key with many
rows lies in many ranges and a range may hold many keys. Windows run inside a range; a summary of each key in each
range (a count, a sum, the last value) is carried over to the ranges after it. Summaries are as many as keys and
ranges together.

Rows that are equal in keys and order stay in one range; their order among each other is arbitrary, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.session import materialize

_TO_HERE, _BEFORE = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)


def over(df: DataFrame, keys: list[str], order: list[str], **functions: tuple) -> DataFrame:
    """df with a column for each function, over rows of equal keys (NULL equals NULL) in ascending order, NULL first.

    ("row_number",), ("rank",), ("dense_rank",), ("ntile", n), ("total",): number of rows of the key;
    ("sum", c), ("count", c): up to the row; ("last", c), ("last_before", c): last value that isn't NULL, up to the row or
    before it; ("lag", c), ("lead", c): the row before or after; ("first", c): of the key's first row.
    """
    names = list(df.columns)
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    at = F.struct(*[F.col(c) for c in order])
    # A second run could draw other bounds, so the ranges are written.
    rows = materialize(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranged").withColumn("__key", key)
    local = W.partitionBy("__range", "__key").orderBy(*order)
    across, all_of = W.partitionBy("__key").orderBy("__range"), W.partitionBy("__key")
    sizes: dict[str, Column] = {"__n": F.count(F.lit(1))}
    inside: dict[str, Column] = {}
    carried: dict[str, Column] = {"__before": F.coalesce(F.sum("__n").over(across.rowsBetween(*_BEFORE)), F.lit(0)), "__total": F.sum("__n").over(all_of)}
    final: dict[str, Column] = {}
    for name, (kind, *arguments) in functions.items():
        s, i, c = f"__s_{name}", f"__i_{name}", f"__c_{name}"
        value = F.col(arguments[0]) if arguments and isinstance(arguments[0], str) else None
        if kind in ("row_number", "rank", "ntile"):
            inside[i] = F.rank().over(local) if kind == "rank" else F.row_number().over(local)
            place = F.col("__before") + F.col(i)
            if kind == "ntile":
                n = F.lit(int(arguments[0])).cast("long")
                small, more = F.floor(F.col("__total") / n), F.col("__total") % n
                long_part = more * (small + 1)
                place = F.when(place <= long_part, F.floor((place - 1) / (small + 1)) + 1).otherwise(more + F.floor((place - long_part - 1) / F.greatest(small, F.lit(1))) + 1)
            final[name] = place.cast("long")
        elif kind == "dense_rank":
            sizes[s], inside[i] = F.count_distinct(at), F.dense_rank().over(local)
            carried[c] = F.coalesce(F.sum(s).over(across.rowsBetween(*_BEFORE)), F.lit(0))
            final[name] = F.col(c) + F.col(i)
        elif kind == "total":
            final[name] = F.col("__total")
        elif kind in ("sum", "count"):
            of = F.sum if kind == "sum" else F.count
            sizes[s], inside[i] = of(value), of(value).over(local.rowsBetween(*_TO_HERE))
            carried[c] = F.sum(s).over(across.rowsBetween(*_BEFORE))
            final[name] = F.coalesce(F.col(i) + F.col(c), i, c)
        elif kind in ("last", "last_before"):
            frame = _TO_HERE if kind == "last" else _BEFORE
            sizes[s], inside[i] = F.max_by(value, F.when(value.isNotNull(), at)), F.last(value, ignorenulls=True).over(local.rowsBetween(*frame))
            carried[c] = F.last(s, ignorenulls=True).over(across.rowsBetween(*_BEFORE))
            final[name] = F.coalesce(i, c)
        elif kind in ("lag", "lead"):
            step = F.lag if kind == "lag" else F.lead
            sizes[s] = (F.max_by if kind == "lag" else F.min_by)(F.struct(value.alias("v")), at)
            inside[i], carried[c] = step(F.struct(value.alias("v"))).over(local), step(s).over(across)
            final[name] = F.coalesce(i, c)["v"]
        elif kind == "first":
            sizes[s] = F.min_by(F.struct(value.alias("v")), at)
            carried[c] = F.first(s).over(across)
            final[name] = F.col(c)["v"]
        else:
            raise ValueError(f"no window function {kind!r}")
    summaries = rows.groupBy("__range", "__key").agg(*[col.alias(n) for n, col in sizes.items()])
    summaries = summaries.select("__range", "__key", *[col.alias(n) for n, col in carried.items()])
    joined = rows.withColumns(inside).join(summaries, ["__range", "__key"])
    return joined.select(*names, *[col.alias(n) for n, col in final.items()])


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, effective: str, values: list[str]) -> DataFrame:
    """left with the values of right's latest row of the group that is in effect; NULL before the first. Both sides in one order; a group may have any number of rows on either side."""
    keys = [c for c in left.columns if c not in values]
    a = left.select(F.col(group).alias("__g"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*keys).alias("__l"), F.lit(None).alias("__r"))
    b = right.select(F.col(group).alias("__g"), F.col(effective).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*values).alias("__r"))
    # NULL times hold nothing and are in effect at no time.
    met = over(a.unionByName(b.where("__t IS NOT NULL AND __g IS NOT NULL")), ["__g"], ["__t", "__side"], __passed=("last", "__r")).where("__side = 1")
    return met.select(*[F.col(f"__l.{c}").alias(c) for c in keys], *[F.col(f"__passed.{v}").alias(v) for v in values])
