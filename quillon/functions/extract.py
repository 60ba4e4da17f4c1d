"""Field extraction by rules (FX-01 to FX-14): each rule is a column, each field an array of candidates.

A candidate is struct(value, confidence, priority, rule, source).  Candidates of one value merge into the one of
highest confidence; the highest (priority, confidence) wins; other values are conflicts.  What the text doesn't give
comes from the file name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .text import clean_ocr, clean_scan

#: The patterns by which fields are found.
N = r"[\x{4e00}-\x{9fa5}A-Za-z0-9（）()]"
FIRM = r"(?:有限公司|有限责任公司|股份有限公司|公司|集团|厂)"
COMPANY_CONTEXT = rf"(?:甲方|乙方|采购方|销售方|供应商|供货方|买方|卖方|付款人|收款人|开票方|购方)[:：]?\s*({N}{{2,40}}?{FIRM})"
COMPANY_GENERIC = rf"({N}{{2,30}}(?:有限公司|有限责任公司|股份有限公司|集团有限公司|集团|公司|工厂|商行|事务所|合作社|医院|学校))"
SELLER_CONTEXT = rf"(?:销售方|销方|卖方|供货方|供应商)(?:信息)?[\s\S]{{0,50}}?名称[:：]?\s*({N}{{2,40}}?{FIRM})"
NOT_BANK = r"(?<!开户银行[\s\S]{0,20})(?![\s\S]{0,24}开户银行)"
INVOICE = r"电子发票|增值税|价税合计|增值税专用发票"
DATE_LABEL = r"(?:开票日期|签订日期|交易日期|交易时间|合同日期|记账日期|入账日期|回单日期|成交日期|日期|签署日期|出票日期)[:：]?\s*"
DATE = r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})日?"
DATE_CN = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
CONTRACT_NO = r"(?i)(?:合同编号|合同号|合同No\.?|Contract\s*(?:No\.?|#)?)[:：]?\s*([A-Za-z0-9][A-Za-z0-9\-_/（）()]{3,39})"
CONTRACT_BARE = (
    r"(?i)(?:双方合同|本合同|双方之?合同|贵我双方合同|合同)(?!单价|数量|金额|编号|号|款|价|期限|内容|约定|总额|条款|条件|总价)"
    r"[:：]?\s*([A-Za-z0-9][A-Za-z0-9\-_/（）()]{3,39})"
)
SUFFIX = r"(?i)YC[-_]?\s*([A-Za-z0-9]{4})"
ORDER_NO = r"(?i)(?:订单号|订单编号|订单No\.?|PO\s*(?:No\.?|#)?|采购单号)[:：]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{2,39})"
INVOICE_NO = r"(?i)(?:发票号码|发票号|发票No\.?|Invoice\s*(?:No\.?|#)?)[:：]?\s*([A-Za-z0-9\-_/]{4,30})"
TWENTY = r"(?<![0-9])((?:[0-9]\s*){20})(?![0-9])"
SETTLED = r"(?:最终结算金额|结算总金额|最终结算价款|结算金额|结算总额|结算价款)[:：]?\s*[¥￥]*\s*([\d,]+(?:\.\d{1,2})?)"
SMALL = r"金额\s*[（(]\s*小写\s*[）)]\s*[:：]?\s*[¥￥]?\s*([\d,]+(?:\.\d{1,2})?)"
TOTAL = r"(?:价税合计|含税合计|合计金额|含税金额|总金额)[\s\S]{0,40}?(?:¥|￥|人民币|RMB)?\s*([\d,]+(?:\.\d{1,2})?)"
CURRENCY = r"(?:人民币|RMB|¥|￥)\s*([\d,]+(?:\.\d{1,2})?)\s*(?:元)?"
AMOUNT_LABEL = r"(?:金额|价款|货款|总价|交易金额)[:：]?\s*([\d,]+(?:\.\d{1,2})?)\s*(?:元|人民币)?"
YUAN = r"([\d,]+(?:\.\d{1,2})?)\s*元"
SUMMARIES = [
    r"摘要[:：]?\s*([\x{4e00}-\x{9fa5}A-Za-z0-9，,。.\-（）() ]{2,30}?)(?=\s*(?:\n|$))",
    r"款项性质[:：]?\s*([\x{4e00}-\x{9fa5}A-Za-z0-9，,。.\-（）() ]{2,30}?)(?=\s*(?:\n|$))",
    r"(?:用途|汇款用途)[:：]?\s*([\x{4e00}-\x{9fa5}A-Za-z0-9，,。.\-（）() ]{2,30}?)(?=\s*(?:\n|$))",
    r"附言[:：]?\s*([\x{4e00}-\x{9fa5}A-Za-z0-9，,。.\-（）() ]{2,30}?)(?=\s*(?:\n|$))",
    r"交易描述[:：]?\s*([\x{4e00}-\x{9fa5}A-Za-z0-9，,。.\-（）() ]{2,30}?)(?=\s*(?:\n|$))",
]
VESSEL = r"(?:船名|船舶名称|船号)[:：]?\s*([\x{4e00}-\x{9fa5}A-Za-z0-9 （）()\-]{2,60}?)(?=[，,;；。]|\s*(?:\r?\n|$))"
VESSEL_QUOTED = r"[“\"]([\x{4e00}-\x{9fa5}A-Za-z0-9\-/（）()]{2,40}?)[”\"]\s*(?:轮|号|船|货轮)"
MATERIAL = (
    r"(?:物料名称|物料|品名|品种|货物名称|货物品名|商品名称)[:：]?\s*"
    r"([\x{4e00}-\x{9fa5}A-Za-z0-9（）()%\.\-]{2,40}?)(?=\s*(?:数量|单位|规格|单价|备注|吨|[，,;；]|$))"
)
MATERIAL_TON = r"(?:吨|T|t)\s*([\x{4e00}-\x{9fa5}A-Za-z]{1,12}(?:粉|矿|钢|煤|油|砂))"
QUANTITY = r"(?:数量|吨数|总数量|重量|净重)[:：]?[\s\S]{0,50}?([\d,]+(?:\.\d{1,2})?)\s*(?:吨|T|t|kg|KG|千克|件|个|张|份|批)?"
TOKEN = r"(?<![\d.])(\d{1,3}(?:,\d{3})+\.\d+|\d+(?:\.\d+)?)(?![\d.])"
FN_CONTRACT = r"(?i)[A-Z]{2,10}(?:（DD）|\(DD\)|[-_])?[-_/]?(?:19|20)\d{2}[-_/]?[A-Z]{0,6}\d{2,10}(?!\d)|[A-Z]{2,6}(?:19|20)\d{2}\d{0,10}(?!\d)"
FN_HASH = r"(?i)(?<![0-9a-z])[0-9a-f]{16,}(?![0-9a-z])"
FN_DATE = r"(?<!\d)(\d{4})[-_.年](\d{1,2})[-_.月](\d{1,2})日?"
FN_SHORT_DATE = r"(?<!\d)(\d{2,3})[-_.](\d{1,2})[-_.](\d{1,2})"
FN_VESSEL = r"([\x{4e00}-\x{9fa5}][\x{4e00}-\x{9fa5}A-Za-z0-9]{1,20}?)(?:号|轮)?船"
FN_MATERIAL = r"([\x{4e00}-\x{9fa5}A-Za-z]{1,12}(?:粉|矿|钢|煤|油|砂|碳|料))"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def day(c: Column, pattern: str, century: Column | None = None) -> Column:
    year, month, d = (found(c, pattern, g) for g in (1, 2, 3))
    year = year if century is None else F.concat(century, year)
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))


def plausible(c: Column) -> Column:
    """FLT-18: amounts, but no whole numbers of 16 digits or more, which are numbers of documents."""
    bare = F.translate(c, ",", "")
    return F.when((bare != "") & (F.contains(bare, F.lit(".")) | (F.char_length(bare) < 16)), bare)


def largest(c: Column, pattern: str, group: int) -> Column:
    """The largest plausible amount of all matches, as text."""
    every = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), plausible)
    every = F.filter(every, lambda v: v.isNotNull())
    return F.array_max(F.transform(every, lambda v: F.struct(v.try_cast("decimal(30,4)").alias("n"), v.alias("v"))))["v"]


def invoice_quantity(c: Column) -> Column:
    """FX-12: of the numbers after 吨, the one whose product with the unit price (four decimals or more) comes within 1 %
    of another number."""
    at = F.instr(c, "吨")
    part = F.when(at > 0, F.substr(c, at, F.lit(500))).otherwise(c)
    tokens = F.transform(F.regexp_extract_all(part, F.lit(TOKEN), F.lit(1)), lambda t: F.translate(t, ",", ""))
    price = F.get(F.filter(tokens, lambda t: t.rlike(r"\.\d{4,}")), F.lit(0)).try_cast("double")
    numbers = F.filter(F.transform(tokens, lambda t: t.try_cast("double")), lambda n: (n > 0) & (F.abs(n - price) > 1e-6))
    gaps = F.transform(
        tokens,
        lambda t: F.struct(
            F.array_min(F.transform(numbers, lambda a: F.abs(t.try_cast("double") * price - a) / a)).alias("gap"), t.alias("v")
        ),
    )
    good = F.filter(gaps, lambda g: (g["v"].try_cast("double") > 0) & (F.abs(g["v"].try_cast("double") - price) >= 1e-9) & (g["gap"] < 0.01))
    return F.when((price > 0) & (F.size(tokens) >= 2), F.array_min(good)["v"])


def summary(c: Column) -> Column:
    """FX-09: by label, not by place."""
    values = [F.regexp_replace(F.trim(found(c, pattern)), "[，,。.]+$", "") for pattern in SUMMARIES]
    return F.coalesce(*[F.when((v != "") & ~v.isin("明细标注", "备注"), v) for v in values])


def vessel(c: Column) -> Column:
    """FX-10: without aliases in parentheses and without blanks."""
    bare = F.regexp_replace(c, "[（(][^）)]*[）)]", "")
    return F.nullif(F.regexp_replace(F.btrim(bare, F.lit(" ()）(")), r"\s+", ""), F.lit(""))


def last_firm(c: Column) -> Column:
    """FX-02: an invoice's last company that isn't near the name of a bank."""
    long = lambda a: F.filter(a, lambda v: (F.char_length(v) >= 4) & F.contains(v, F.lit("公司")))
    stated = long(F.regexp_extract_all(c, F.lit(NOT_BANK + COMPANY_CONTEXT), F.lit(1)))
    other = long(F.regexp_extract_all(c, F.lit(NOT_BANK + COMPANY_GENERIC), F.lit(1)))
    return F.element_at(F.when(F.size(stated) > 0, stated).when(F.size(other) > 0, other), -1)


@dataclass(frozen=True)
class Rule:
    field: str
    name: str
    value: Callable[[Column], Column]
    confidence: float
    priority: float
    invoice: bool = False  # only in texts of invoices


TEXT_RULES = [
    Rule("company", "company_context", lambda c: found(c, COMPANY_CONTEXT), 0.9, 100),
    Rule("company", "company_generic", lambda c: found(c, COMPANY_GENERIC), 0.7, 70),
    Rule("seller", "seller_context", lambda c: found(c, SELLER_CONTEXT), 0.9, 90),
    Rule("seller", "invoice_seller", last_firm, 0.85, 85, True),
    Rule("date", "invoice_date", lambda c: day(c, DATE_CN), 0.95, 96, True),
    Rule("date", "date_context", lambda c: day(c, DATE_LABEL + DATE), 0.95, 100),
    Rule("date", "date_generic", lambda c: day(c, DATE), 0.8, 80),
    Rule("contract_no", "contract_context", lambda c: found(c, CONTRACT_NO), 0.85, 100),
    Rule("contract_no", "contract_bare", lambda c: found(c, CONTRACT_BARE), 0.8, 85),
    Rule("contract_suffix", "contract_suffix_yc", lambda c: F.upper(found(c, SUFFIX)), 0.65, 78),
    Rule("order_no", "order_context", lambda c: found(c, ORDER_NO), 0.85, 100),
    Rule("invoice_no", "invoice_no_anchor", lambda c: F.regexp_replace(found(c, TWENTY), r"\s", ""), 0.95, 98, True),
    Rule("invoice_no", "invoice_context", lambda c: found(c, INVOICE_NO), 0.85, 100),
    Rule("amount", "settlement_amount_anchor", lambda c: plausible(found(c, SETTLED)), 0.97, 99),
    Rule("amount", "invoice_amount_yuan", lambda c: largest(c, r"[¥￥]\s*([\d,]+\.\d{2})", 1), 0.95, 96, True),
    Rule("amount", "invoice_amount_max", lambda c: F.when(largest(c, r"[¥￥]\s*([\d,]+\.\d{2})", 1).isNull(), largest(c, r"\d[\d,]*\.\d{1,2}", 0)), 0.85, 90, True),
    Rule("amount", "receipt_amount_small", lambda c: F.translate(found(c, SMALL), ",", ""), 0.96, 97),
    Rule("amount", "amount_total", lambda c: plausible(found(c, TOTAL)), 0.95, 95),
    Rule("amount", "amount_currency", lambda c: plausible(found(c, CURRENCY)), 0.9, 90),
    Rule("amount", "amount_context", lambda c: plausible(found(c, AMOUNT_LABEL)), 0.75, 75),
    Rule("amount", "amount_yuan", lambda c: plausible(found(c, YUAN)), 0.6, 60),
    Rule("summary", "receipt_summary", summary, 0.85, 88),
    Rule("vessel", "vessel_context", lambda c: vessel(found(c, VESSEL)), 0.85, 85),
    Rule("vessel", "vessel_quoted", lambda c: vessel(found(c, VESSEL_QUOTED)), 0.8, 80),
    Rule("material", "material_context", lambda c: found(c, MATERIAL), 0.8, 80),
    Rule("material", "material_ton", lambda c: found(c, MATERIAL_TON), 0.7, 70),
    Rule("quantity", "invoice_quantity_math", invoice_quantity, 0.9, 92, True),
    Rule("quantity", "quantity_context", lambda c: F.translate(found(c, QUANTITY), ",", ""), 0.85, 85),
]
NAME_RULES = [
    Rule("contract_no", "filename_contract", lambda c: F.when(~c.rlike(FN_HASH), F.upper(F.regexp_replace(found(c, FN_CONTRACT, 0), r"\s+", ""))), 0.6, 60),
    Rule("date", "filename_date", lambda c: day(c, FN_DATE), 0.55, 60),
    Rule("date", "filename_short_date", lambda c: day(c, FN_SHORT_DATE, F.when(F.char_length(found(c, FN_SHORT_DATE)) == 2, F.lit("20")).otherwise(F.lit("2"))), 0.5, 60),
    Rule("vessel", "filename_vessel", lambda c: found(c, FN_VESSEL), 0.55, 60),
    Rule("material", "filename_material", lambda c: found(c, FN_MATERIAL), 0.55, 60),
]
CANDIDATE = "array<struct<confidence:double,priority:double,rule:string,source:string,value:string>>"


HIT = "array<struct<p:double,c:double,rule:string,value:string>>"


def hits(text: Column, rules: list[Rule], field: str) -> Column:
    """What the rules of one field find."""
    is_invoice = text.rlike(INVOICE)
    own = []
    for rule in rules:
        if rule.field == field:
            value = F.nullif(F.trim(rule.value(text)), F.lit(""))
            value = F.when(is_invoice, value) if rule.invoice else value
            own.append(F.struct(F.lit(-float(rule.priority)).alias("p"), F.lit(-rule.confidence).alias("c"), F.lit(rule.name).alias("rule"), value.alias("value")))
    if not own:
        return F.array().cast(HIT)
    return F.filter(F.array(*own), lambda h: h["value"].isNotNull()).cast(HIT)


def candidates(hits: Column, source: str = "RULE") -> Column:
    """The candidates of one field, best first, one for each value.  `hits` is read for each hit, so it must be a column that is there
    already: as an expression all rules would be matched again for each hit."""
    # of one value the candidate of highest confidence, then highest priority, stays
    best = F.filter(hits, lambda h: ~F.exists(hits, lambda o: (o["value"] == h["value"]) & ((o["c"] < h["c"]) | ((o["c"] == h["c"]) & (o["p"] < h["p"])))))
    entry = lambda h: F.struct((-h["c"]).alias("confidence"), (-h["p"]).alias("priority"), h["rule"].alias("rule"), F.lit(source).alias("source"), h["value"].alias("value"))
    return F.transform(F.array_sort(best), entry).cast(CANDIDATE)


def extract(docs: DataFrame, key: str, text: str, filename: str | None = None, fields: list[str] = config.FIELD_ORDER, clean: bool = True) -> DataFrame:
    """FX-14: a row for each document and field that was found: key, field, value, confidence, priority, rule, source,
    conflicts (other values of the text, best first) and position (the order of fields)."""
    body = clean_scan(clean_ocr(F.col(text)))["text"] if clean else F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), body.alias("_text"), (F.col(filename) if filename else F.lit("")).alias("_name"))
    every = [
        F.struct(
            F.lit(field).alias("field"), F.lit(k).alias("position"),
            hits(F.col("_text"), TEXT_RULES, field).alias("own"),
            hits(F.trim(F.coalesce(F.col("_name"), F.lit(""))), NAME_RULES, field).alias("spare"),
        )
        for k, field in enumerate(fields)
    ]
    long = rows.select(key, F.inline(F.array(*every))).filter("size(own) > 0 OR size(spare) > 0")
    long = long.withColumns({"own": candidates(F.col("own")), "spare": candidates(F.col("spare"), "FILENAME")})
    chosen = F.when(F.size("own") > 0, F.get("own", F.lit(0))).otherwise(F.get("spare", F.lit(0)))
    out = long.withColumn("_best", chosen).filter(F.col("_best").isNotNull())
    rest = F.transform(F.slice("own", F.lit(2), F.greatest(F.size("own") - 1, F.lit(0))), lambda c: c["value"])
    return out.select(key, "field", "_best.value", "_best.confidence", "_best.priority", "_best.rule", "_best.source", rest.alias("conflicts"), "position")
