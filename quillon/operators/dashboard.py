"""Dashboards and alerts (AGG-01 to AGG-06, WIN-10, AGG-27, AGG-38)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.money import calendar


def ratio(a: Column, b: Column) -> Column:
    """Four decimals, exactly rounded; null if b is 0."""
    return F.round(F.try_divide(a.cast("decimal(18,6)"), b), 4).cast("double")


def as_of(rows: DataFrame, ts: str = "created_at"):
    """The last day of the data: 'today' of reports that must be repeatable."""
    return rows.agg(F.max(F.to_date(ts))).first()[0]


def daily_trend(rows: DataFrame, day: Column, good: Column, bad: Column, last, days: int) -> DataFrame:
    """AGG-03, AGG-04: total, ok, failed and the good share of each of the last `days` days, those without rows too."""
    counts = rows.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.count_if(good).alias("ok"), F.count_if(bad).alias("failed"))
    full = calendar(rows.sparkSession, last, days).join(counts, "day", "left").na.fill(0, ["total", "ok", "failed"])
    return full.select("day", "total", "ok", "failed", ratio(F.col("ok"), F.col("total")).alias("success_rate"))


def counts(docs: DataFrame, last) -> DataFrame:
    """AGG-01 in one pass."""
    day = F.to_date("created_at")
    return docs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "archived").alias("archived"),
        F.count_if(F.col("status") == "need_review").alias("need_review"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(day == F.lit(str(last)).cast("date")).alias("today"),
    )


def by_type(docs: DataFrame, kind: str = "document_type", none: str = "未识别") -> DataFrame:
    """AGG-02."""
    return docs.groupBy(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(none)).alias("type")).agg(F.count("*").alias("n"))


def surges(rows: DataFrame, kind: str, day: Column, last) -> DataFrame:
    """AGG-05, WIN-10: types with 5 or more in the last week and 3 times the week before, or none then."""
    end = F.lit(str(last)).cast("date")
    age = F.datediff(end, day)
    weeks = rows.groupBy(F.col(kind).alias("type")).agg(F.count_if(age.between(0, 6)).alias("last7"), F.count_if(age.between(7, 13)).alias("prev7"))
    return weeks.filter((F.col("last7") >= config.SURGE_LEAST) & ((F.col("prev7") == 0) | (F.col("last7") >= config.SURGE_TIMES * F.col("prev7"))))


def fail_alerts(rows: DataFrame, day: Column, failed: Column, last) -> DataFrame:
    """AGG-06: the alerts for today and for the week, with their numbers."""
    end = F.lit(str(last)).cast("date")
    age = F.datediff(end, day)
    n = rows.agg(
        F.count_if(age == 0).alias("today"), F.count_if((age == 0) & failed).alias("today_failed"),
        F.count_if(age.between(0, 6)).alias("week"), F.count_if(age.between(0, 6) & failed).alias("week_failed"),
    )
    one = lambda name, total, bad: F.struct(F.lit(name).alias("alert"), F.col(total).alias("total"), F.col(bad).alias("failed"), ratio(F.col(bad), F.col(total)).alias("rate"))
    long = n.select(F.inline(F.array(one("today", "today", "today_failed"), one("week", "week", "week_failed"))))
    today = (F.col("alert") == "today") & (F.col("failed") >= 1) & (F.col("rate") >= config.FAIL_TODAY)
    week = (F.col("alert") == "week") & (F.col("total") >= config.FAIL_WEEK_TOTAL) & (F.col("failed") >= config.FAIL_WEEK_FAILED) & (F.col("rate") >= config.FAIL_WEEK)
    return long.filter(today | week)


def job_counters(operations: DataFrame) -> DataFrame:
    """AGG-27: progress of each job, from its outcomes."""
    return operations.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("result") == "ok").alias("success"), F.count_if(F.col("result") == "failed").alias("failed"),
        F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"),
    )
