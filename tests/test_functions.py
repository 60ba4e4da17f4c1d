"""Functions against the tables of FIXTURES.md and against properties."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import classify, extract, hashing, money, template, text
from quillon.plans import texts as samples


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "expected"), [("HSYCXS（DD）-2026-0027", ["HSYCXS(DD)-2026-0027", "HSYCXS-2026-0027"]), ("", []), (None, []), ("(x)y", ["(X)Y", "Y"])])
def test_variants(spark, value, expected):
    assert one(spark, text.contract_variants(F.col("v")), v=value) == expected


@pytest.mark.parametrize(("value", "expected"), [(" hsycxs（dd）-01 ", "HSYCXS(DD)-01"), (None, ""), ("a-1）)", "A-1"), ("　a　b", "AB")])
def test_norm_no(spark, value, expected):
    assert one(spark, text.norm_no(F.col("v")), v=value) == expected


@pytest.mark.parametrize(("value", "expected"), [("人民币 1,234.50 元", None), ("￥1,234.50", "1234.50"), ("", None), ("(120.5)", "-120.50"), ("1.005", "1.01"), (None, None)])
def test_to_money(spark, value, expected):
    assert one(spark, money.to_money(F.col("v")), v=value) == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize(("value", "expected"), [("1,234.56", "1234.56"), ("¥ 1,018,000.00", "1018000.00"), ("(1,000)", "-1000.00"), ("", None), ("摘要", None), ("-", None), ("$2.345", "2.34")])
def test_detail_amount(spark, value, expected):
    assert one(spark, money.detail_amount(F.col("v")), v=value) == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize(("value", "expected"), [("2026-05-14", date(2026, 5, 14)), ("2026/5/14", date(2026, 5, 14)), ("2026年5月14日", date(2026, 5, 14)), ("45000", date(2023, 3, 15)), ("", None), ("99999", None)])
def test_days(spark, value, expected):
    assert one(spark, money.detail_day(F.col("v")), v=value) == expected


@pytest.mark.parametrize(("word", "amount", "expected"), [("付款", "1", "payment"), ("回款", "1", "receipt"), ("", "-100", "payment"), ("", "100", "receipt")])
def test_kind(spark, word, amount, expected):
    assert one(spark, money.detail_kind(F.col("v"), F.col("a").cast("double")), v=word, a=amount) == expected


def test_clean_text(spark):
    value = "2026 年 08 月 20 日 对账说明\r\n金额：人民币 128,500.00 元\n\n\n\n！！！！！！ 2026/1/2 2026年3月"
    assert one(spark, text.clean_text(F.col("v")), v=value) == "2026-08-20 对账说明\n金额：128500.00\n\n！！！ 2026-01-02 2026-03"


def test_clean_ocr(spark):
    value = "1234\n仅供参考 x\n购\n买\n方\n第 3 页\n数量 7996\n正文\n7996\n末一\n末二\n末三\n- 2 -\n"
    assert one(spark, text.clean_ocr(F.col("v")), v=value) == "购买方\n数量 7996\n正文\n7996\n末一\n末二\n末三"


def test_digits_and_dates(spark):
    assert one(spark, text.repair_digits(F.col("v")), v="¥ 1O0,5S0 与 2O26 Oslo") == "¥100,550 与 2026 Oslo"
    assert one(spark, text.unify_dates(F.col("v")), v="2026年6月8日 2026.7.9 26-8-4 026-08-14 20260814 20261399") == "2026-06-08 2026-07-09 2026-08-04 2026-08-14 2026-08-14 20261399"


def test_rule_confidence(spark):
    rows = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0), (3, 3.0, 0), (5, 5.0, 0), (1, 3.0, 1), (9, 30.0, 3), (0, 0.0, 0)], "n int, score double, hits int")
    got = [float(r[0]) for r in rows.select(classify.rule_confidence(F.col("n"), F.col("score"), F.col("hits"))).collect()]
    assert got == [0.6, 0.75, 0.85, 0.91, 0.68, 0.98, 0.0]


def test_simhash(spark):
    assert one(spark, hashing.hamming(F.col("a"), F.col("b")), a="0" * 16, b="f" * 16) == 64
    assert one(spark, hashing.hamming(F.col("a"), F.col("b")), a="x", b="f" * 16) == 64
    assert one(spark, hashing.hamming(F.col("a"), F.col("b")), a="8000000000000000", b="8000000000000001") == 1
    words = spark.createDataFrame([("a", w) for w in ("合同", "金额", "船名")] + [("b", w) for w in ("发票", "税额", "开票日期")], "k string, w string")
    a, b = (r.simhash for r in hashing.simhash(words, ["k"], "w").orderBy("k").collect())
    assert (int(a, 16) ^ int(b, 16)).bit_count() > 20


def fields_of(spark, key):
    rows = extract.extract(samples.literal(spark, samples.TEXTS, "id int, v string, name string"), "id", "v", "name").filter(F.col("id") == key).collect()
    return {r.field: (r.value, r.source) for r in rows}


def test_extract_contract(spark):
    got = fields_of(spark, 1)
    assert got["contract_no"] == ("HSYCXS（DD）-2026-0027", "RULE")
    assert got["company"][0] == "上海华山贸易有限公司" and got["date"][0] == "2026-06-08" and got["vessel"][0] == "伦敦勇士号"
    assert got["material"][0] == "PB粉" and got["quantity"][0] == "10000" and got["amount"][0] == "8500000.00"


def test_extract_invoice(spark):
    got = fields_of(spark, 2)
    assert got["invoice_no"][0] == "26332000000123456789" and got["date"][0] == "2026-06-18" and got["amount"][0] == "81250.00"
    assert got["quantity"][0] == "100" and got["seller"][0] == "上海华山贸易有限公司"


def test_extract_receipt_and_names(spark):
    got = fields_of(spark, 3)
    assert got["amount"][0] == "1500000.00" and got["summary"][0] == "货款" and got["date"][0] == "2026-07-01"
    got = fields_of(spark, 4)
    assert got["contract_no"] == ("SJWLCG（DD）-2026-0109", "FILENAME") and got["material"][1] == "FILENAME"
    assert "contract_no" not in fields_of(spark, 5)


def test_template(spark):
    fields = {"date": F.lit("2026-06-08"), "document_type": F.lit("发票"), "company": F.lit("山西宏达钢铁有限公司"), "amount": F.lit("1234.56")}
    render = lambda t: spark.range(1).select(template.rendered(t, fields, F.lit(".PDF"))).first()[0]
    assert render(None) == "2026-06-08_发票_山西宏达钢铁有限公司.pdf"
    assert render("{日期:compact}_{公司:short}_{金额|int}") == "20260608_山西宏达钢铁_1234.pdf"
    assert render("{{IF 类型 == 发票}}A{{IF vessel}}x{{ELSE}}y{{END}}{{ELSE}}B{{END}}_{日期:cn}") == "Ay_2026年06月08日.pdf"
    with pytest.raises(ValueError):
        render("{{IF a}}x")


def test_diff_key(spark):
    import hashlib

    key = spark.range(1).select(classify.diff_key(F.lit("t"), F.lit("up"), F.lit("r"), F.lit("1"), F.lit(None).cast("string"), F.array(F.lit(3), F.lit(1)))).first()[0]
    assert key == hashlib.sha1(b"t|up|r|1||1,3").hexdigest()[:12]


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab（）() 　\n-0９A", max_size=12), min_size=40, max_size=40))
def test_norm_properties(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    twice = rows.select(text.norm_no(text.norm_no(v)).alias("a"), text.norm_no(v).alias("b"), text.contract_variants(v).alias("c"), text.norm_text(text.norm_text(v)).alias("d"), text.norm_text(v).alias("e"))
    for r in twice.collect():
        assert r.a == r.b and r.d == r.e
        assert r.c == ([] if not r.b else r.c) and all(r.c) and (not r.b or r.c[0] == r.b)


def test_rules_are_matched_once_for_each_text(spark):
    """The candidates of a field are merged from what the rules found, without matching them again for each."""
    from quillon.functions import extract

    docs = spark.createDataFrame([(1, "签订日期：2026-06-08")], "id int, v string")
    found = extract.extract(docs, "id", "v", fields=["date"])
    assert [(r.value, r.rule) for r in found.collect()] == [("2026-06-08", "date_context")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    merging = [line for line in plan.splitlines() if "exists(" in line]
    assert merging and not any("regexp_extract" in line for line in merging)
