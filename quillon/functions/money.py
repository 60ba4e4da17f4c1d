"""Amounts and dates as columns (FN-40 to FN-49, FN-66 to FN-68).  Failure is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def _number(c: Column) -> Column:
    bare = F.regexp_replace(F.translate(c, ",，¥￥元　 ", ""), r"^\((.*)\)$", "-$1")
    return F.when(bare.rlike(NUMBER), bare)


def to_money(c: Column) -> Column:
    """FN-40: null for what isn't a number, never 0."""
    return _number(c.cast("string")).try_cast(MONEY)


def money_or_zero(c: Column) -> Column:
    """FN-41, FN-68."""
    return F.coalesce(to_money(c), F.lit(0).cast(MONEY))


def detail_amount(c: Column) -> Column:
    """FN-42: as to_money, with $ and half-even rounding."""
    return F.bround(_number(F.translate(c.cast("string"), "$", "")).try_cast("decimal(24,6)"), 2).cast(MONEY)


def to_day(c: Column) -> Column:
    """FN-43: four formats, up to the first blank, or a spreadsheet's day number from 20000 to 80000."""
    s = F.substring_index(F.trim(c.cast("string")), " ", 1)
    serial = F.when(s.rlike(r"^\d{5}(\.\d+)?$"), s.try_cast("double"))
    day = F.when((serial > 20000) & (serial < 80000), F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")))
    formats = [("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^\\d{4}/\\d{1,2}/\\d{1,2}$", "yyyy/M/d"), ("^\\d{4}\\.\\d{1,2}\\.\\d{1,2}$", "yyyy.M.d"), ("^\\d{8}$", "yyyyMMdd")]
    return F.coalesce(day, *[F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f)).cast("date")) for p, f in formats])


def detail_day(c: Column) -> Column:
    """FN-44: to_day and Chinese dates."""
    return to_day(F.regexp_replace(F.trim(c.cast("string")), r"^(\d{4})年(\d{1,2})月(\d{1,2})日?$", "$1-$2-$3"))


def day_text(c: Column) -> Column:
    """FN-45: yyyy-MM-dd, or the text as it is."""
    return F.coalesce(F.date_format(detail_day(c), "yyyy-MM-dd"), F.coalesce(F.trim(c), F.lit("")))


def amount_text(c: Column) -> Column:
    """FN-46: two decimals, half-even; null is ''."""
    return F.coalesce(F.bround(c, 2).cast(MONEY).cast("string"), F.lit(""))


def period(down: Column, up: Column) -> Column:
    """FN-47: yyyy-MM of the downstream date, else of the upstream one, else ''."""
    return F.coalesce(F.date_format(F.coalesce(down, up), "yyyy-MM"), F.lit(""))


def calendar(spark, last, days: int):
    """FN-48: a row `day` for each of the last `days` days to `last` (a date, or text of one)."""
    return spark.range(days).select(F.date_sub(F.lit(str(last)).cast("date"), (days - 1 - F.col("id")).cast("int")).alias("day"))


def daily_cron(text: str) -> tuple[int, int]:
    """FN-49: (hour, minute) of 'HH:MM' or 'M H * * *'."""
    parts = text.split()
    hour, minute = (parts[1], parts[0]) if len(parts) == 5 else text.split(":")
    hour, minute = int(hour), int(minute)
    if not (0 <= hour < 24 and 0 <= minute < 60):
        raise ValueError(f"not a time of day: {text}")
    return hour, minute


def detail_kind(c: Column, amount: Column) -> Column:
    """FN-66: payment or receipt by words, then by sign."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(s.rlike("付款|支付|支出|payment|pay"), F.lit("payment"))
        .when(s.rlike("回款|收款|收入|到账|receipt|receive"), F.lit("receipt"))
        .when(amount < 0, F.lit("payment"))
        .otherwise(F.lit("receipt"))
    )
