"""Ledgers: sheets, merging, external details, lookups by header (AGG-07 to AGG-09, AGG-16 to AGG-18, JON-07 to JON-09, SRC-10 to SRC-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.money import MONEY, detail_amount, detail_day, detail_kind
from ..functions.text import norm_no


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def norm_header(text: str) -> str:
    """FN-04, FN-14 on the driver, for a few headers."""
    import re
    import unicodedata

    return re.sub(r"[\s()\[\]【】\-_/\\.:,;、]", "", unicodedata.normalize("NFKC", text or "")).lower()


def column_map(headers: list[str], aliases: dict[str, list[str]] = config.COLUMN_ALIASES) -> dict[str, int]:
    """SRC-13, WIN-11: the position of each standard field by its first alias that is there; a second price column is the sale price,
    and a sale-side amount or date is *_sale."""
    norm = [norm_header(h) for h in headers]
    found: dict[str, int] = {}
    for field, names in aliases.items():
        for name in map(norm_header, names):
            if name in norm:
                found[field] = norm.index(name)
                break
    prices = [i for i, h in enumerate(norm) if h == norm_header("单价")]
    if len(prices) > 1:
        found["unit_price"], found["unit_price_sale"] = prices[0], prices[1]
    for field, names in {"unit_price_sale": ["销售单价"], "amount_sale": ["销售合同金额", "销售结算金额", "销售金额"], "date_sale": ["销售合同签订日期", "销售日期"]}.items():
        for name in map(norm_header, names):
            if name in norm and found.get(field.removesuffix("_sale")) != norm.index(name):
                found.setdefault(field, norm.index(name))
    return found


def header_row(rows: list[list[str]], least: int = 2, within: int = 10) -> int | None:
    """SRC-12: the first of the first ten rows with two mapped columns or more."""
    return next((i for i, r in enumerate(rows[:within]) if len(column_map([str(c or "") for c in r])) >= least), None)


def settlement_sums(rows: DataFrame, key: str) -> DataFrame:
    """AGG-07: settlement, with the total column or else its parts, for each contract.  Quirk Q5 as it behaves: a line of blanks
    counts 0, not null."""
    up = F.coalesce(F.col("total"), F.coalesce("purchase", zero()) + F.coalesce("tail", zero()) + F.coalesce("tail_invoice", zero()))
    return rows.groupBy(norm_no(F.col(key)).alias("contract_key")).agg(
        F.sum(up).cast(MONEY).alias("up_settlement"), F.sum(F.coalesce("sale", zero())).cast(MONEY).alias("down_settlement"), F.sum(F.coalesce("interest", zero())).cast(MONEY).alias("interest")
    )


def payment_sums(rows: DataFrame, key: str, order: str) -> DataFrame:
    """AGG-08: the sums of each contract, the first purchase number that isn't empty, and the first invoice date."""
    sums = [F.sum(F.coalesce(c, zero())).cast(MONEY).alias(c) for c in ("pay_amount", "receipt_amount", "interest_receivable", "interest_received")]
    number = F.nullif(F.col("up_contract_no"), F.lit(""))
    return rows.groupBy(norm_no(F.col(key)).alias("contract_key")).agg(
        *sums, F.min_by(number, F.when(number.isNotNull(), F.col(order))).alias("up_contract_no"), F.min("invoice_date").alias("invoice_date")
    )


def merge_lines(rows: DataFrame, key: str, order: str, sums: list[str], firsts: list[str], dates: list[str], lists: list[str]) -> DataFrame:
    """AGG-09: one row for each business line: sums that skip nulls (null if all are), first values that aren't empty, first dates,
    and distinct lists in order."""
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order)))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col(order), F.col(c).alias("v"))))), lambda x: x["v"]))
    return rows.groupBy(key).agg(
        *[F.sum(c).cast(MONEY).alias(c) for c in sums],
        *[first(c).alias(c) for c in firsts],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in dates],
        *[ordered(c).alias(f"{c}_list") for c in lists],
    )


def enrich(main: DataFrame, extra: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """JON-09, SET-01: number lists of an auxiliary sheet join the main lines' lists; lines that only it has are ignored."""
    own = extra.select(key, *[F.col(c).alias(f"_x_{c}") for c in lists])
    empty = F.array().cast("array<string>")
    joined = main.join(own, key, "left")
    return joined.withColumns({c: F.array_union(F.coalesce(c, empty), F.coalesce(f"_x_{c}", empty)) for c in lists}).drop(*[f"_x_{c}" for c in lists])


def backfilled(lines: DataFrame, settlement: DataFrame, payment: DataFrame, variants: DataFrame) -> DataFrame:
    """JON-07, JON-08: settlement and payment of each line, by the first contract key that one of its variants hits; missing ones are
    flagged.  variants: business_no, contract_key, position."""

    def one(side: DataFrame, flag: str, prefix: str) -> DataFrame:
        own = variants.join(side, "contract_key").groupBy("business_no").agg(*[F.min_by(c, "position").alias(prefix + c) for c in side.columns if c != "contract_key"], F.lit(False).alias(flag))
        return own

    out = lines.join(one(settlement, "settlement_missing", ""), "business_no", "left").join(one(payment, "payment_missing", "pay_"), "business_no", "left")
    number = F.coalesce(F.nullif(F.col("up_contract_no"), F.lit("")), F.col("pay_up_contract_no"))
    return out.withColumn("up_contract_no", number).na.fill(True, ["settlement_missing", "payment_missing"])


def import_details(rows: DataFrame, batch_no: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """SRC-15: accepted details (absolute amounts) and skipped rows (no business number or no amount); columns maps business_no,
    amount and, if there are any, occurred_on, kind and note to the sheet's headers.  Missing required columns are an error."""
    missing = [c for c in ("business_no", "amount") if columns.get(c) not in rows.columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    own = lambda name: F.col(f"`{columns[name]}`") if columns.get(name) in rows.columns else F.lit(None).cast("string")
    amount = detail_amount(own("amount"))
    parsed = rows.select(
        F.lit(batch_no).alias("batch_no"), F.nullif(F.trim(own("business_no")), F.lit("")).alias("business_no"), detail_day(own("occurred_on")).alias("occurred_on"),
        F.abs(amount).alias("amount"), detail_kind(own("kind"), amount).alias("kind"), own("note").alias("note"),
    )
    good = F.col("business_no").isNotNull() & F.col("amount").isNotNull()
    return parsed.filter(good), parsed.filter(~good)


def detail_totals(details: DataFrame, by: str) -> DataFrame:
    """AGG-16, AGG-17: receipts, payments, number and last day by business line or batch."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount")).otherwise(zero())).cast(MONEY)
    return details.groupBy(by).agg(of("receipt").alias("receipt_total"), of("payment").alias("payment_total"), F.count("*").alias("n"), F.max("occurred_on").alias("last_on"))


def detail_page(details: DataFrame, business_no: str | None = None, batch_no: str | None = None, limit: int = 500) -> DataFrame:
    """FLT-11, SRT-09: details of a line or a batch, the newest first, between 1 and 5000 of them."""
    rows = details
    for c, v in (("business_no", business_no), ("batch_no", batch_no)):
        rows = rows if v is None else rows.filter(F.col(c) == v)
    return rows.orderBy(F.desc_nulls_last("occurred_on"), F.desc("id")).limit(max(1, min(5000, limit)))
