"""What the cells of workbooks mean: sheets by name, the contract sheet, sheets by their header, uploads (SRC-10 to SRC-12, SRC-14)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import to_day, to_money
from ..functions.text import norm_no
from ..operators.ledger import column_map, header_row, norm_header

# Headers of the contract sheet by field, in order of preference; the header of other numbers, and those that end its search.
HEADERS = {
    "business_no": ["业务线", "业务线号", "业务编号"],
    "up_contract_no": ["采购合同编号", "采购合同号", "采购合同编号oa"],
    "down_contract_no": ["销售合同编号oa", "销售合同编号", "销售合同号"],
    "up_contract_amount": ["采购合同金额", "采购金额"],
    "down_contract_amount": ["销售合同金额", "销售金额"],
    "up_contract_date": ["采购合同签订日期", "采购日期"],
    "down_contract_date": ["销售合同签订日期", "销售日期"],
    "supplier": ["供应商"],
    "customer": ["采购商名称", "销售客户", "采购商"],
    "vessel": ["船名"],
    "material": ["物料名称", "物料"],
}
OTHER_NUMBER = "2.0编号"
ENDS = ["业务线", "采购合同签订日期", "销售合同签订日期"]


def norm(header: str | None) -> str:
    """FN-01 on the driver, for a few headers."""
    return "".join((header or "").replace("（", "(").replace("）", ")").split()).lower()


def sheet_named(names: list[str], wanted: str) -> str | None:
    """SRC-10: the sheet of that name, else the first whose name holds it or is held by it."""
    return wanted if wanted in names else next((n for n in names if wanted in n or n in wanted), None)


def contract_columns(headers: list[str]) -> dict[str, int]:
    """SRC-11: the position of each field, the leftmost column that has one of its headers; up_alt_no and down_alt_no are the nearest
    column of other numbers to the right of the contract number's, unless a column that ends the search is nearer."""
    own = [norm(h) for h in headers]
    found = {}
    for field, names in HEADERS.items():
        wanted = {norm(n) for n in names}
        if (at := next((i for i, h in enumerate(own) if h in wanted), None)) is not None:
            found[field] = at
    others, ends = [i for i, h in enumerate(own) if h == OTHER_NUMBER], [i for i, h in enumerate(own) if h in ENDS]
    for side in ("up", "down"):
        if (anchor := found.get(f"{side}_contract_no")) is not None:
            behind = lambda places: min((i for i in places if i > anchor), default=len(own))  # noqa: B023, E731
            if behind(others) < behind(ends):
                found[f"{side}_alt_no"] = behind(others)
    return found


def contract_lines(rows: DataFrame, headers: list[str], cells: str = "cells") -> DataFrame:
    """SRC-11: business lines of the contract sheet's rows (an array of texts each); rows without a business number are left out."""
    at = contract_columns(headers)
    cell = lambda f: F.get(cells, F.lit(at[f])) if f in at else F.lit(None).cast("string")
    numbers = {f: norm_no(cell(f)) for f in ("business_no", "up_contract_no", "down_contract_no", "up_alt_no", "down_alt_no")}
    listed = lambda a, b: F.filter(F.array(numbers[a], numbers[b]), lambda n: n != "")
    plain: dict[str, Column] = {f: F.trim(F.coalesce(cell(f), F.lit(""))) for f in ("supplier", "customer", "vessel", "material")}
    out = rows.select(
        *[c.alias(f) for f, c in numbers.items()], listed("up_contract_no", "up_alt_no").alias("up_contract_nos"), listed("down_contract_no", "down_alt_no").alias("down_contract_nos"),
        *[to_money(cell(f)).alias(f) for f in ("up_contract_amount", "down_contract_amount")], *[to_day(cell(f)).alias(f) for f in ("up_contract_date", "down_contract_date")],
        *[c.alias(f) for f, c in plain.items()],
    )
    return out.filter("business_no <> ''")


def sheet_headers(cells: DataFrame, within: int = 10) -> DataFrame:
    """SRC-12, SRC-13: of each sheet (path, sheet) whose first rows have a header: its row, the column of each standard field, and the
    columns of contract numbers.  A sheet's first ten rows are all that is looked at."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        own = [[str(c or "") for c in r] for r in rows.sort_values("row")["cells"]]
        at = header_row(own, within=within)
        if at is None:
            return pd.DataFrame([], columns=["path", "sheet", "header", "fields", "contracts"])
        names = [norm_header(h) for h in own[at]]
        contracts = [k for k, n in enumerate(names) if "合同" in n and ("编号" in n or n.endswith("合同号"))]
        return pd.DataFrame([(rows["path"].iloc[0], rows["sheet"].iloc[0], rows["row"].sort_values().iloc[at], column_map(own[at]), contracts)], columns=["path", "sheet", "header", "fields", "contracts"])

    first = cells.filter(F.col("row") <= within).select("path", "sheet", "row", "cells")
    return first.groupBy("path", "sheet").applyInPandas(one, "path string, sheet string, header int, fields map<string,int>, contracts array<int>")


def configured_rows(cells: DataFrame) -> DataFrame:
    """SRC-12: path, sheet, row, fields (text of each standard field that isn't empty) and contracts (all contract numbers in the order of
    their columns) of the rows below a sheet's header; rows without either are none.  Days lose their time."""
    heads = sheet_headers(cells).select(F.col("path").alias("_p"), F.col("sheet").alias("_s"), "header", F.col("fields").alias("_at"), F.col("contracts").alias("_numbers"))
    rows = cells.join(heads, (F.col("path") == F.col("_p")) & (F.col("sheet") == F.col("_s"))).filter(F.col("row") > F.col("header"))
    text = lambda k: F.regexp_extract(F.trim(F.coalesce(F.get("cells", k), F.lit(""))), r"(?s)^(\d{4}-\d\d-\d\d)(?= \d\d:\d\d:\d\d$)|^(.*)$", 0)
    fields = F.map_filter(F.transform_values("_at", lambda _, k: text(k)), lambda _, v: v != "")
    contracts = F.filter(F.transform("_numbers", lambda k: text(k)), lambda v: v != "")
    out = rows.select("path", "sheet", "row", fields.alias("fields"), contracts.alias("contracts"))
    return out.filter((F.size("fields") > 0) | (F.size("contracts") > 0))


def uploaded(known: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-14: the sources after an upload (name, content_hash, sheet_config): a content that is known already isn't taken again; one
    of a known name takes its place and keeps its sheet configuration."""
    fresh = new.join(known.select("content_hash").distinct(), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    fresh = fresh.groupBy("name").agg(F.max_by("content_hash", F.struct("uploaded_at", "content_hash")).alias("content_hash"), F.max("uploaded_at").alias("uploaded_at"))
    old = known.select("name", F.col("content_hash").alias("_hash"), F.col("uploaded_at").alias("_at"), "sheet_config")
    both = old.join(fresh, "name", "full_outer")
    return both.select("name", F.coalesce("content_hash", "_hash").alias("content_hash"), F.coalesce("uploaded_at", "_at").alias("uploaded_at"), "sheet_config")
