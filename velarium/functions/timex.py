"""Named relative times: a rule and a reference date give a first and a last day, both included.

Clean semantics: ends of future periods are whole; weeks begin on Monday; fiscal periods honour the
calendar's first month and day; rolling windows have at least one day; everything follows from the
reference date alone.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calendar:
    kind: str = "NATURAL"
    start_month: int = 1
    start_day: int = 1


@dataclass(frozen=True)
class TimeRule:
    """kind: CUSTOM, RECURRING, HOLIDAY, ROLLING, SINCE_START or OFFSET; granularity: YEAR QUARTER MONTH WEEK DAY."""

    kind: str
    granularity: str = ""
    offset: int = 0
    days: int = 30
    start: date | None = None
    end: date | None = None
    shift_start: int = 0
    shift_end: int = 0


def add_months(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def period_start(day: date, granularity: str, cal: Calendar = Calendar()) -> date:
    if granularity == "DAY":
        return day
    if granularity == "WEEK":
        return day - timedelta(days=day.weekday())
    if granularity == "MONTH":
        return day.replace(day=1)
    fiscal = cal.kind == "FISCAL"
    first = date(day.year, cal.start_month if fiscal else 1, cal.start_day if fiscal else 1)
    if first > day:
        first = add_months(first, -12)
    if granularity == "YEAR":
        return first
    if granularity == "QUARTER":
        starts = [add_months(first, 3 * k) for k in range(4)]
        return max(s for s in starts if s <= day)
    raise ValueError(f"unknown granularity {granularity}")


def shift(start: date, granularity: str, k: int) -> date:
    if granularity in ("DAY", "WEEK"):
        return start + timedelta(days=k * (7 if granularity == "WEEK" else 1))
    return add_months(start, k * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[granularity])


def in_year(day: date, year: int) -> date:
    """The same day of another year; the 29th of February is the month's last."""
    return day.replace(year=year, day=min(day.day, calendar.monthrange(year, day.month)[1]))


def preview(rule: TimeRule, today: date, cal: Calendar = Calendar(), holidays: dict[int, tuple[date, date]] | None = None, active: bool = True) -> str:
    """What a rule means on a day, as text; `disabled` if it isn't active, `no period` where it has none."""
    if not active:
        return "disabled"
    period = resolve(rule, today, cal, holidays)
    return f"{period[0].isoformat()} to {period[1].isoformat()}" if period else "no period"


_PATTERN = re.compile(r"(?:近|last\s*)\s*([0-9]+|N)\s*(?:天|days?)", re.I)


def from_pattern(text: str, n: int | None = None, default: int = 30) -> TimeRule:
    """`last 7 days`, or with a parameter `last N days` (`近N天`), whose value is n or else the default."""
    match = _PATTERN.fullmatch(text.strip())
    if not match:
        raise ValueError(f"not a relative time: {text}")
    return TimeRule("ROLLING", days=(n or default) if match[1] in "Nn" else int(match[1]))


def resolve(rule: TimeRule, today: date, cal: Calendar = Calendar(), holidays: dict[int, tuple[date, date]] | None = None) -> tuple[date, date] | None:
    """None where the rule has no period (a custom rule without dates, a holiday that year doesn't have)."""
    if rule.kind == "CUSTOM":
        return (rule.start, rule.end) if rule.start and rule.end else None
    if rule.kind == "RECURRING":
        return tuple(in_year(d, today.year) for d in (rule.start, rule.end))
    if rule.kind == "HOLIDAY":
        period = (holidays or {}).get(today.year)
        if not period:
            return None
        a, b = rule.shift_start, rule.shift_end
        if a < 0 and b < 0:
            return period[0] + timedelta(days=a), period[0] + timedelta(days=b)
        if a > 0 and b > 0:
            return period[1] + timedelta(days=a), period[1] + timedelta(days=b)
        return period[0] + timedelta(days=a), period[1] + timedelta(days=b)
    if rule.kind == "ROLLING":
        if rule.days < 1:
            raise ValueError("a rolling window has at least one day")
        return today - timedelta(days=rule.days - 1), today
    if rule.kind == "SINCE_START":
        if rule.granularity not in ("YEAR", "QUARTER", "MONTH"):
            return None
        return period_start(today, rule.granularity, cal), today
    start = shift(period_start(today, rule.granularity, cal), rule.granularity, rule.offset)
    end = shift(start, rule.granularity, 1) - timedelta(days=1)
    return start, end if rule.offset else min(end, today)


def retail_445(spark: SparkSession, first: date, years: int) -> DataFrame:
    """date, fiscal_year, period (1-12), week (1-52): quarters of 4, 4 and 5 weeks from the given Monday."""
    days = spark.range(years * 364).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"), (F.floor(F.col("id") / 364) + 1).cast("int").alias("fiscal_year"), (F.floor(F.col("id") % 364 / 7) + 1).cast("int").alias("week"))
    in_quarter = (F.col("week") - 1) % 13
    month = F.when(in_quarter < 4, 1).when(in_quarter < 8, 2).otherwise(3)
    return days.select("date", "fiscal_year", (F.floor((F.col("week") - 1) / 13) * 3 + month).cast("int").alias("period"), "week")
