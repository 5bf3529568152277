"""Keyset, offset and page-number paging, with signed cursors. Limits bound what leaves Spark; plans are top-k, not full sorts."""

from __future__ import annotations

import base64
import bisect
import hashlib
import hmac
import itertools
import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from velarium.session import discard, materialize, scratch_dir

PAGE, MOST = 20, 50
#: Rows of a page of a timeline, and rows that a window over pages keeps.
TIMELINE, WINDOW = 40, 80


def _order(keys: list[str], forward: bool = True, nulls_last: bool = False) -> list[Column]:
    """Ascending with NULL first (or last), or exactly the other way round."""
    if forward:
        return [F.asc_nulls_last(k) if nulls_last else F.asc_nulls_first(k) for k in keys]
    return [F.desc_nulls_first(k) if nulls_last else F.desc_nulls_last(k) for k in keys]


def _beyond(keys: list[str], values: tuple, forward: bool, nulls_last: bool = False) -> Column:
    """Which rows come after (or before) values in the order of keys. NULL is at its end of the order, and equal to itself."""
    parts = []
    for k, key in enumerate(keys):
        same = [F.col(a).eqNullSafe(F.lit(b)) for a, b in zip(keys[:k], values[:k], strict=True)]
        nulls_ahead = nulls_last == forward  # whether NULL lies in the direction of the page
        if values[k] is None:
            step = F.lit(False) if nulls_ahead else F.col(key).isNotNull()
        else:
            step = F.col(key) > F.lit(values[k]) if forward else F.col(key) < F.lit(values[k])
            step = step | F.col(key).isNull() if nulls_ahead else step
        parts.append(reduce(lambda a, b: a & b, [*same, step]))
    return reduce(lambda a, b: a | b, parts)


def keyset(df: DataFrame, keys: list[str], size: int = PAGE, after: tuple | None = None, before: tuple | None = None, nulls_last: bool = False) -> DataFrame:
    """The next (or, with before, the previous) rows in the order of keys, which must be unique together; NULL first, or last."""
    size = max(1, min(MOST, size))
    if before is not None:
        return df.where(_beyond(keys, before, False, nulls_last)).orderBy(*_order(keys, False, nulls_last)).limit(size).orderBy(*_order(keys, True, nulls_last))
    rows = df.where(_beyond(keys, after, True, nulls_last)) if after is not None else df
    return rows.orderBy(*_order(keys, True, nulls_last)).limit(size)


def page(df: DataFrame, keys: list[str], number: int, size: int = PAGE) -> DataFrame:
    """Page `number` from 1, clamped to the pages there are."""
    pages = max(1, -(-df.count() // size))
    number = max(1, min(number, pages))
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def numbered(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first rows with their place from 1; only those go through the window."""
    return df.orderBy(*order).limit(size).withColumn("place", F.row_number().over(W.orderBy(*order)))


def sign_cursor(secret: bytes, scope: dict, position: list) -> str:
    """A token for a position, bound to what it was made for (epoch, run, stream, filter, direction)."""
    body = json.dumps({"scope": scope, "position": position}, sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(body + hmac.digest(secret, body, hashlib.sha256)).decode().rstrip("=")


def read_cursor(secret: bytes, scope: dict, token: str) -> list:
    """The position of a token; ValueError if it was changed or made for something else."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        body, signature = raw[:-32], raw[-32:]
        if not hmac.compare_digest(signature, hmac.digest(secret, body, hashlib.sha256)):
            raise ValueError("cursor was changed")
        held = json.loads(body)
    except (ValueError, UnicodeDecodeError) as error:
        raise ValueError("not a cursor") from error
    if held["scope"] != scope:
        raise ValueError("cursor is for something else")
    return held["position"]


@dataclass(frozen=True)
class Page:
    """rows in order, a cursor to go on from each end (None where nothing is there), whether more follows, and how many there are in all."""

    rows: DataFrame
    before: str | None
    after: str | None
    has_more: bool
    total: int


def read_page(df: DataFrame, keys: list[str], secret: bytes, scope: dict, size: int = PAGE, cursor: str | None = None, backward: bool = False, nulls_last: bool = False) -> Page:
    """The page after (or before) a cursor that an earlier page of the same scope gave. One row more than asked for tells whether there is more. Each page sorts and counts df; where many are read, make a PageIndex once."""
    size = max(1, min(MOST, size))
    at = tuple(read_cursor(secret, scope, cursor)) if cursor else None
    rows = df.where(_beyond(keys, at, not backward, nulls_last)) if at is not None else df
    found = rows.orderBy(*_order(keys, not backward, nulls_last)).limit(size + 1).collect()  # a page
    more, found = len(found) > size, found[:size]
    found = found[::-1] if backward else found
    sign = lambda row: sign_cursor(secret, scope, [row[k] for k in keys])
    ahead, behind = (at is not None, more) if backward else (more, at is not None)
    return Page(df.sparkSession.createDataFrame(found, df.schema), sign(found[0]) if found and behind else None, sign(found[-1]) if found and ahead else None, more, df.count())


def offset_page(df: DataFrame, order: list[str], asked: dict, first: int = PAGE, after: str | None = None) -> Page:
    """A page by a cursor `digest:offset`, whose digest is of what was asked; one of another question is refused."""
    digest = hashlib.sha256(json.dumps(asked, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    offset = 0
    if after is not None:
        own, _, number = after.partition(":")
        if own != digest or not number.isdigit():
            raise ValueError("cursor is of another question")
        offset = int(number)
    first, total = min(100, max(1, first)), df.count()
    end = min(total, offset + first)
    return Page(df.orderBy(*order).offset(offset).limit(first), None, f"{digest}:{end}" if end < total else None, end < total, total)


def slide(held: list, fresh: list, key, forward: bool = True, most: int = WINDOW) -> list:
    """Rows in view after a page more: none twice, and no more than `most`, dropped at the other end."""
    seen = {key(r) for r in held}
    new = [r for r in fresh if key(r) not in seen]
    return [*held, *new][-most:] if forward else [*new, *held][:most]


class CursorExpired(ValueError):
    """The row that a cursor stands at is gone."""


class PageIndex:
    """Rows in ranges of an order, written once, with how many rows come before each range.

    A page by number reads the one or two ranges that hold its rows, whichever number it has, and of these only the rows at its
    places; a page by cursor finds the range of its row among the ranges' ends. Totals, and whether more follows,
    come from the counts. Ranges are as many as the partitions they were written with, and their table is all that the driver holds.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Open an index that build() wrote."""
        self.spark, self.path = spark, path
        ranges = spark.read.parquet(f"{path}/ranges").orderBy("__range").collect()
        self.keys: list[str] = ranges[0]["keys"] if ranges else []
        self.nulls_last: bool = ranges[0]["nulls_last"] if ranges else False
        self.ranges = [r for r in ranges if r["n"]]
        self.before = list(itertools.accumulate((r["n"] for r in self.ranges), initial=0))
        self.total = self.before[-1]
        self.rows = spark.read.schema(StructType.fromJson(json.loads(ranges[0]["schema"]))).parquet(f"{path}/rows")

    @classmethod
    def build(cls, df: DataFrame, keys: list[str], path: str | None = None, nulls_last: bool = False, ranges: int | None = None) -> PageIndex:
        """keys must be unique together. ranges: how many, where the session's number of partitions is not wanted."""
        spark, order = df.sparkSession, _order(keys, True, nulls_last)
        path = path or f"{scratch_dir(spark)}/pages-{uuid.uuid4().hex}"
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        dealt = materialize(dealt.withColumn("__range", F.spark_partition_id()), "pages")  # a second run could draw other bounds
        placed = dealt.withColumn("__at", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
        placed.write.partitionBy("__range").parquet(f"{path}/rows")
        discard(dealt)
        held = placed.schema
        rows = spark.read.schema(held).parquet(f"{path}/rows")
        at = lambda f: f(F.struct(*keys), F.col("__at"))
        sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), at(F.min_by).alias("low"), at(F.max_by).alias("high"))
        if sizes.isEmpty():
            sizes = spark.range(1).select(F.lit(0).alias("__range"), F.lit(0).cast("long").alias("n"))
        sizes.select("*", F.array(*[F.lit(k) for k in keys]).alias("keys"), F.lit(nulls_last).alias("nulls_last"), F.lit(held.json()).alias("schema")).coalesce(1).write.parquet(f"{path}/ranges")
        return cls(spark, path)

    def _read(self, first: int, last: int) -> DataFrame:
        """Rows of some ranges, which the reader finds by their folders."""
        return self.rows.where(F.col("__range").isin([r["__range"] for r in self.ranges[first : last + 1]]))

    def slice(self, offset: int, size: int) -> DataFrame:
        """Rows at places offset to offset + size - 1."""
        offset, end = max(0, offset), min(self.total, offset + size)
        if offset >= end:
            return self.rows.limit(0).drop("__range", "__at")
        first, last = bisect.bisect_right(self.before, offset) - 1, bisect.bisect_left(self.before, end) - 1
        parts = [
            (F.col("__range") == self.ranges[k]["__range"]) & F.col("__at").between(offset - self.before[k] + 1, end - self.before[k]) for k in range(first, last + 1)
        ]
        return self._read(first, last).where(reduce(lambda a, b: a | b, parts)).orderBy(*_order(self.keys, True, self.nulls_last)).limit(end - offset).drop("__range", "__at")

    def page(self, number: int, size: int = PAGE) -> DataFrame:
        """Page `number` from 1, clamped to the pages there are."""
        return self.slice((max(1, min(number, self.pages(size))) - 1) * size, size)

    def pages(self, size: int = PAGE) -> int:
        return max(1, -(-self.total // size))

    def _rank(self, row: tuple) -> tuple:
        """A row of keys as Python compares what Spark orders."""
        out = []
        for value in row:
            if value is None:
                out.append((3 if self.nulls_last else 0,))
            elif isinstance(value, float) and value != value:
                out.append((2,))
            else:
                out.append((1, value.encode() if isinstance(value, str) else value))
        return tuple(out)

    def place(self, row: tuple) -> int:
        """How many rows come before a row of keys; CursorExpired if it isn't there. Reads one range."""
        k = bisect.bisect_left(self.ranges, self._rank(row), key=lambda r: self._rank(tuple(r["high"])))
        if k < len(self.ranges):
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(self.keys, row, strict=True)])
            if found := self._read(k, k).where(same).select("__at").head():
                return self.before[k] + found[0] - 1
        raise CursorExpired("the row of this cursor is gone; read anew")

    def read(self, secret: bytes, scope: dict, size: int = PAGE, cursor: str | None = None, backward: bool = False) -> Page:
        """The page after (or before) a cursor of an earlier page of the same scope; without one, the first (or last)."""
        size = max(1, min(MOST, size))
        if cursor:
            at = self.place(tuple(read_cursor(secret, scope, cursor)))
            start, end = (max(0, at - size), at) if backward else (at + 1, min(self.total, at + 1 + size))
        else:
            start, end = (max(0, self.total - size), self.total) if backward else (0, min(self.total, size))
        rows = self.slice(start, end - start)
        ends = rows.collect() if end > start else []  # a page
        sign = lambda row: sign_cursor(secret, scope, [row[k] for k in self.keys])
        more = start > 0 if backward else end < self.total
        return Page(self.spark.createDataFrame(ends, rows.schema), sign(ends[0]) if ends and start > 0 else None, sign(ends[-1]) if ends and end < self.total else None, more, self.total)
