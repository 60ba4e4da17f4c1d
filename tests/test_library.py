"""Workbooks, configuration checks and compatible characters on small inputs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import compatible
from quillon.sources import checks, workbook


def test_sheets():
    assert workbook.sheet_named(["云创总合同2026", "合同"], "云创总合同") == "云创总合同2026"
    assert workbook.sheet_named(["a", "b"], "b") == "b" and workbook.sheet_named(["合同"], "物流合同") == "合同" and workbook.sheet_named(["x"], "y") is None


HEADERS = ["业务线", "采购合同编号", "2.0编号", "采购合同签订日期", "采购合同金额", "销售合同编号OA", "x", "2.0编号", "供应商", "船名"]


def test_contract_sheet(spark):
    assert workbook.contract_columns(HEADERS)["up_alt_no"] == 2 and workbook.contract_columns(HEADERS)["down_alt_no"] == 7
    assert "up_alt_no" not in workbook.contract_columns(["采购合同编号", "采购合同签订日期", "2.0编号"])
    rows = [["yc-1 ", "cg（1）", "alt-1", "2026-01-02", "1,000.5元", "xs-1）", "", None, " 山西 ", "海兴"], ["", "cg-2", None, None, None, None, None, None, None, None], ["yc-3"]]
    got = {r.business_no: r for r in workbook.contract_lines(spark.createDataFrame([(r,) for r in rows], "cells array<string>"), HEADERS).collect()}
    one = got["YC-1"]
    assert set(got) == {"YC-1", "YC-3"} and one.up_contract_nos == ["CG(1", "ALT-1"] and one.down_contract_nos == ["XS-1"] and str(one.up_contract_amount) == "1000.50"
    assert str(one.up_contract_date) == "2026-01-02" and one.supplier == "山西" and got["YC-3"].up_contract_nos == [] and got["YC-3"].up_contract_amount is None


def test_uploads(spark):
    schema = "name string, content_hash string, uploaded_at int"
    known = spark.createDataFrame([("a.xlsx", "h1", 1, "{}"), ("b.xlsx", "h2", 1, None)], schema + ", sheet_config string")
    new = spark.createDataFrame([("a.xlsx", "h3", 2), ("c.xlsx", "h2", 2), ("d.xlsx", "h4", 2), ("e.xlsx", "h4", 2)], schema)
    got = {r.name: (r.content_hash, r.sheet_config) for r in workbook.uploaded(known, new).collect()}
    assert got["a.xlsx"] == ("h3", "{}") and got["b.xlsx"] == ("h2", None) and "c.xlsx" not in got and len(got) == 3


def test_checks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    settings = {"folders": {"archive": str(tmp_path / "in"), "gone": str(tmp_path / "x")}, "watch": [str(tmp_path), str(tmp_path / "y")], "review": 0.6, "auto": 0.5, "providers": {"mail": {"host": "h", "user": ""}}}
    got = {r.name: r.level for r in checks.check(spark, settings).collect()}
    assert got["folder:archive"] == "ok" and got["folder:gone"] == "error" and got["thresholds"] == "error" and got["provider:mail"] == "warning"
    assert checks.watched(str(tmp_path), [str(tmp_path / "in")]) and not checks.watched(str(tmp_path / "in"), [str(tmp_path / "z")])
    assert checks.mapping("") == {} and checks.mapping('{"a": 1}') == {"a": "1"}
    with pytest.raises(ValueError):
        checks.mapping("[1]")


def test_compatible(spark):
    texts = ["Ａｂ１２　ｘ", "①⑩㈠", "㎡ ㎏ ﬁ ﬀ", "x²", "plain", "Ⅳ", "１／２", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(compatible(F.col("t"))).collect()]
    want = [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [g for g, t in zip(got, texts, strict=True) if t != "①⑩㈠"] == [w for w, t in zip(want, texts, strict=True) if t != "①⑩㈠"]
