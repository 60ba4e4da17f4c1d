"""Reference data as small tables (SRC-20): the category tree, keyword rules, file-name rules and rename templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What a new installation starts with, by path of category, in this order.
CATEGORY_TREE = {
    "合同": ["采购合同", "销售合同", "框架合同", "补充协议", "结算单", "货权转移"],
    "财务": ["发票", "银行回单", "对账单", "收付款凭证"],
    "业务": ["报价单", "订单", "出货单", "入库单"],
    "项目资料": [],
    "证照": [],
    "其他": [],
}
#: Of each category the keywords; priority 10, weight 1.
KEYWORD_RULES = {
    "合同/销售合同": ["销售合同", "购销合同", "销售方", "买方", "卖方", "合同编号", "合同金额"],
    "合同/采购合同": ["采购合同", "采购方", "供应商", "供货方", "采购编号", "采购金额"],
    "财务/发票": ["增值税专用发票", "增值税普通发票", "发票号码", "开票日期", "税率", "税额"],
    "财务/银行回单": ["银行电子回单", "付款人", "收款人", "交易金额", "交易日期", "回单"],
    "财务/对账单": ["对账单", "对账", "账期"],
    "财务/收付款凭证": ["收款凭证", "付款凭证", "收据", "进账单"],
    "业务/报价单": ["报价单", "报价", "询价"],
    "业务/订单": ["订单", "订单号", "订货", "订购"],
    "业务/出货单": ["出货单", "发货单", "出库单", "送货单"],
    "业务/入库单": ["入库单", "收货单", "入库"],
    "合同/结算单": ["结算单", "结算", "结算确认", "结算明细"],
    "合同/货权转移": ["货权转移", "货权", "货转", "货权转移确认单"],
}
#: Pattern and category; priority 100.
FILENAME_RULES = [("SJWLXS", "合同/销售合同"), ("HSYCXS", "合同/销售合同"), ("SJWLCG", "合同/采购合同"), ("HSYCCG", "合同/采购合同")]
RENAME_TEMPLATES = {
    "合同/结算单": "{日期}_{船名}_{合同号}_{物料}_{类型}",
    "合同/货权转移": "{日期}_{船名}_{合同号}_{物料}_{类型}",
}


def categories(spark: SparkSession) -> DataFrame:
    """id, parent_id, name, path, sort_order; parents before their children."""
    rows: list[tuple] = []
    for name, children in CATEGORY_TREE.items():
        own = len(rows) + 1
        rows.append((own, None, name, name, len(rows)))
        for k, child in enumerate(children):
            rows.append((len(rows) + 1, own, child, f"{name}/{child}", k))
    return spark.createDataFrame(rows, "id long, parent_id long, name string, path string, sort_order int")


def keyword_rules() -> list[dict]:
    return [{"category": c, "keyword": k, "match_type": "contains", "priority": 10, "weight": 1.0, "enabled": True} for c, ks in KEYWORD_RULES.items() for k in ks]


def filename_rules() -> list[dict]:
    return [{"id": i, "pattern": p, "category": c, "priority": 100, "enabled": True} for i, (p, c) in enumerate(FILENAME_RULES, 1)]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(keyword_rules(), "category string, keyword string, match_type string, priority int, weight double, enabled boolean")


def rename_templates(spark: SparkSession) -> DataFrame:
    """category, template."""
    return spark.createDataFrame(list(RENAME_TEMPLATES.items()), "category string, template string")
