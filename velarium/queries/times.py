"""Relative times over orders: for each rule, the period and what falls into it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions.timex import Calendar, TimeRule, resolve, retail_445
from velarium.registry import query, register
from velarium.session import table

TODAY = date(1998, 5, 20)
FISCAL = Calendar("FISCAL", 4, 6)
HOLIDAYS = {1998: (date(1998, 5, 1), date(1998, 5, 5))}

_RULES = {
    "time_custom": (TimeRule("CUSTOM", start=date(1996, 2, 1), end=date(1996, 3, 15)), "1996-02-01", "1996-03-15"),
    "time_recurring": (TimeRule("RECURRING", start=date(2000, 6, 1), end=date(2000, 8, 31)), "1998-06-01", "1998-08-31"),
    "time_holiday": (TimeRule("HOLIDAY"), "1998-05-01", "1998-05-05"),
    "time_holiday_before": (TimeRule("HOLIDAY", shift_start=-7, shift_end=-1), "1998-04-24", "1998-04-30"),
    "time_holiday_after": (TimeRule("HOLIDAY", shift_start=1, shift_end=3), "1998-05-06", "1998-05-08"),
    "time_rolling": (TimeRule("ROLLING", days=30), "1998-04-21", "1998-05-20"),
    "time_ytd": (TimeRule("SINCE_START", "YEAR"), "1998-01-01", "1998-05-20"),
    "time_qtd": (TimeRule("SINCE_START", "QUARTER"), "1998-04-01", "1998-05-20"),
    "time_mtd": (TimeRule("SINCE_START", "MONTH"), "1998-05-01", "1998-05-20"),
    "time_year": (TimeRule("OFFSET", "YEAR", -1), "1997-01-01", "1997-12-31"),
    "time_quarter": (TimeRule("OFFSET", "QUARTER", -1), "1998-01-01", "1998-03-31"),
    "time_month": (TimeRule("OFFSET", "MONTH", 1), "1998-06-01", "1998-06-30"),
    "time_week": (TimeRule("OFFSET", "WEEK", -1), "1998-05-11", "1998-05-17"),
    "time_day": (TimeRule("OFFSET", "DAY", -3), "1998-05-17", "1998-05-17"),
    "time_fiscal_year": (TimeRule("OFFSET", "YEAR", -1), "1997-04-06", "1998-04-05"),
    "time_fiscal_quarter": (TimeRule("OFFSET", "QUARTER", -1), "1998-01-06", "1998-04-05"),
}


def _orders_in(rule: TimeRule, cal: Calendar):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first, last = resolve(rule, TODAY, cal, HOLIDAYS)
        day = F.to_date("o_orderdate")
        rows = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit(first), F.date_add(F.lit(last), 1)) & day.between(F.lit(first), F.lit(last)))
        return rows.agg(F.lit(first).alias("first_day"), F.lit(last).alias("last_day"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount")).select(F.col("first_day"), F.col("last_day"), "n", "amount")

    return run


for _name, (_rule, _first, _last) in _RULES.items():
    register(_name, _orders_in(_rule, FISCAL if "fiscal" in _name else Calendar()), f"SELECT DATE '{_first}' AS first_day, DATE '{_last}' AS last_day, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{_first}' AND DATE '{_last}'")


@query("""WITH d AS (SELECT DATE '1995-01-02' + k::INTEGER AS date, k // 364 + 1 AS fiscal_year, k % 364 // 7 + 1 AS week FROM range(0, 2184) t(k)),
    c AS (SELECT date, fiscal_year, (week - 1) // 13 * 3 + CASE WHEN (week - 1) % 13 < 4 THEN 1 WHEN (week - 1) % 13 < 8 THEN 2 ELSE 3 END AS period FROM d)
    SELECT fiscal_year, period, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN c ON CAST(o_orderdate AS DATE) = date GROUP BY 1, 2""")
def time_retail445(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = retail_445(spark, date(1995, 1, 2), 6)
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount"))
    return daily.join(days, "date").groupBy(F.col("fiscal_year").cast("long").alias("fiscal_year"), F.col("period").cast("long").alias("period")).agg(F.sum("n").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("SELECT o_orderpriority, round(avg(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-05-20')), 4) AS avg_age, sum(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 0 ELSE 1 END)::BIGINT AS on_workdays FROM orders WHERE o_orderdate < '1998-05-20' GROUP BY 1")
def time_age_workdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ'1998-05-20'")
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg(F.datediff(F.lit(TODAY), F.to_date("o_orderdate"))), 4).alias("avg_age"), F.sum(F.when(F.weekday("o_orderdate") < 5, 1).otherwise(0)).alias("on_workdays"))


@query("SELECT business_date, count(*) AS n FROM (SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS business_date FROM events) GROUP BY 1")
def time_business_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A business day ends at four in the morning."""
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 4 HOURS"))
    return table(spark, sf_dir, "events").groupBy(day.alias("business_date")).agg(F.count(F.lit(1)).alias("n"))
