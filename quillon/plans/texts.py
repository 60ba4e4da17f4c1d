"""Queries of keys, text, rules, fields, fingerprints and groups.

Chinese texts come from literals, which both engines read alike; the other queries take the generic documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, extract, hashing, money, template, text
from ..operators import cluster, dossier, eav, provider, rules
from ..sources import files, seeds
from ..sources import tables as t
from ..sources.shared import written
from .catalogue import DOCS, FIELDS, query, with_

#: Literals: id, text.
NUMBERS = [(1, "HSYCXS（DD）-2026-0027"), (2, " hsycxs（dd）-01 "), (3, "SJWLCG (DD)-2026-YC0453）"), (4, "HSYC-TZS-2026-05-12）"), (5, None), (6, "　XS　2026 ")]
CONTRACT = "销售合同\n合同编号：HSYCXS（DD）-2026-0027\n甲方：上海华山贸易有限公司\n乙方：山西宏达钢铁有限公司\n签订日期：2026年6月8日\n船名：伦敦勇士号\n品名：PB粉\n数量：10000 吨\n合同金额：8,500,000.00元\n"
INVOICE = "电子发票（增值税专用发票）\n发票号码：26332000000123456789\n开票日期：2026年06月18日\n购买方信息 名称：山西宏达钢铁有限公司\n销售方信息 名称：上海华山贸易有限公司\n*矿产品*PB粉 吨 100 812.5000 81250.00\n¥71902.65 ¥9347.35\n价税合计（小写）¥81250.00\n"
RECEIPT = "银行电子回单\n付款人：山西宏达钢铁有限公司\n收款人：上海华山贸易有限公司\n金额（小写）\n1,500,000.00\n摘要：货款\n交易日期：2026-07-01\n"
TEXTS = [(1, CONTRACT, "HSYCXS（DD）-2026-0027.pdf"), (2, INVOICE, "发票.pdf"), (3, RECEIPT, "2026-07-01 回单.pdf"), (4, "", "SJWLCG（DD）-2026-0109_海兴168船_铁矿粉.pdf"), (5, None, "ef252262087373843227213824214.pdf")]


def literal(spark, rows, schema="id int, v string"):
    return spark.createDataFrame(rows, schema)


def values(rows, names="id, v"):
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"x AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names}))"


BARE = "regexp_replace(translate(coalesce(v, ''), '（）', '()'), '[\\s\\x{3000}]+', '', 'g')"


def order_key():
    return F.col("o_orderkey")


def customer_key():
    return F.col("c_custkey")


def keyed(spark, d, *choices, table="orders", key="o_orderkey"):
    """id and a text for each order (or row of another table): one of the choices (columns) by its key."""
    k = F.pmod(F.col(key), F.lit(len(choices)))
    own = choices[-1]
    for i, c in enumerate(choices[:-1]):
        own = F.when(k == i, c).otherwise(own)
    return t.table(spark, d, table).select(F.col(key).alias("id"), own.alias("v"))


def text_of(*parts):
    """Literals and columns, one after the other; keys as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def case_of(*choices):
    """The SQL of keyed()."""
    cases = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"x AS (SELECT o_orderkey AS id, CASE o_orderkey % {len(choices)} {cases} END AS v FROM orders)"


@query("key_norm", f"""{with_(case_of(*["NULL" if v is None else f"o_orderkey || '{v}'" for _, v in NUMBERS]))}, n AS (SELECT id, lower({BARE}) AS text, upper(regexp_replace({BARE}, '\\)+$', '')) AS no FROM x),
 w AS (SELECT *, regexp_replace(no, '\\([^)]*\\)', '', 'g') AS bare FROM n)
 SELECT id, text, no, CASE WHEN no = '' THEN '' WHEN bare = no OR bare = '' THEN no ELSE no || '|' || bare END AS variants FROM w""")
def key_norm(spark, d):
    """Each order's key before a contract number."""
    v = F.col("v")
    rows = keyed(spark, d, *[F.lit(None).cast("string") if x is None else text_of(order_key(), x) for _, x in NUMBERS])
    return rows.select("id", text.norm_text(v).alias("text"), text.norm_no(v).alias("no"), F.array_join(text.contract_variants(v), "|").alias("variants"))


MONEY_SQL = "regexp_replace(translate(v, ',，¥￥元　 ', ''), '^\\((.*)\\)$', '-\\1')"


FMT = "format('{:,.2f}', o_totalprice)"
AMOUNT_CASES = case_of(f"'￥' || {FMT}", f"' ' || {FMT} || ' 元'", f"'(' || {FMT} || ')'", f"'人民币 ' || {FMT}", "''", "NULL", f"'-' || replace({FMT}, ',', '')", "'-'", "'¥ ' || o_orderkey")


@query("money_parse", f"""{with_(AMOUNT_CASES)}, n AS (SELECT id, CASE WHEN regexp_matches({MONEY_SQL}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN {MONEY_SQL} END AS s FROM x)
 SELECT id, TRY_CAST(s AS DECIMAL(18,2)) AS amount, coalesce(TRY_CAST(s AS DECIMAL(18,2)), 0) AS or_zero, coalesce(CAST(TRY_CAST(s AS DECIMAL(18,2)) AS VARCHAR), '') AS text FROM n""")
def money_parse(spark, d):
    """Each order's price as people write amounts."""
    price = F.format_number("o_totalprice", 2)
    rows = keyed(spark, d, text_of("￥", price), text_of(" ", price, " 元"), text_of("(", price, ")"), text_of("人民币 ", price), F.lit(""), F.lit(None).cast("string"), text_of("-", F.replace(price, F.lit(","), F.lit(""))), F.lit("-"), text_of("¥ ", order_key()))
    a = money.to_money(F.col("v"))
    return rows.select("id", a.alias("amount"), money.money_or_zero(F.col("v")).alias("or_zero"), money.amount_text(a).alias("text"))


DAY_CASES = case_of(*[f"strftime(o_orderdate, '{f}')" for f in ("%Y-%m-%d", "%Y/%-m/%-d", "%Y.%-m.%-d", "%Y%m%d")], "CAST(40000 + o_orderkey % 5000 AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d') || ' 10:11:12'", "''", "NULL", "strftime(o_orderdate, '%Y年%-m月%-d日')", "'2026-02-30'")


@query("date_parse", f"""{with_(DAY_CASES)}, s AS (SELECT id, trim(split_part(trim(v), ' ', 1)) AS s FROM x), z AS (SELECT id, s, regexp_replace(s, '^(\\d{{4}})年(\\d{{1,2}})月(\\d{{1,2}})日?$', '\\1-\\2-\\3') AS c FROM s),
 p AS (SELECT id, s, CASE WHEN regexp_matches(s, '^\\d{{5}}$') THEN DATE '1899-12-30' + CAST(s AS INTEGER) WHEN regexp_matches(s, '^\\d{{8}}$') THEN CAST(try_strptime(s, '%Y%m%d') AS DATE)
   WHEN regexp_matches(s, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}$') THEN CAST(try_strptime(translate(s, '/.', '--'), '%Y-%m-%d') AS DATE) END AS day,
   CASE WHEN regexp_matches(c, '^\\d{{5}}$') THEN DATE '1899-12-30' + CAST(c AS INTEGER) WHEN regexp_matches(c, '^\\d{{8}}$') THEN CAST(try_strptime(c, '%Y%m%d') AS DATE)
   WHEN regexp_matches(c, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}$') THEN CAST(try_strptime(translate(c, '/.', '--'), '%Y-%m-%d') AS DATE) END AS detail FROM z)
 SELECT p.id, day, detail, coalesce(strftime(detail, '%Y-%m-%d'), trim(v), '') AS text FROM p JOIN x ON x.id = p.id""")
def date_parse(spark, d):
    """Each order's day as people write days."""
    day, v = lambda f: F.date_format("o_orderdate", f), F.col("v")
    rows = keyed(spark, d, day("yyyy-MM-dd"), day("yyyy/M/d"), day("yyyy.M.d"), day("yyyyMMdd"), (40_000 + order_key() % 5000).cast("string"), F.concat(day("yyyy-MM-dd"), F.lit(" 10:11:12")), F.lit(""), F.lit(None).cast("string"), day("yyyy年M月d日"), F.lit("2026-02-30"))
    return rows.select("id", money.to_day(v).alias("day"), money.detail_day(v).alias("detail"), money.day_text(v).alias("text"))


@query("clean_text")
def clean_text(spark, d):
    return t.documents(spark, d).select("id", F.sha2(text.clean_text(F.col("extracted_text")), 256).alias("cleaned"))


@query("clean_amounts", """SELECT o_orderkey AS id, '甲方 于2026-06-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') || ' 付款1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '000.00！！！' AS text FROM orders""")
def clean_amounts(spark, d):
    """FN-30 to FN-33 on a Chinese sentence for each order."""
    v = text_of("\r\n 甲方　 于2026年6月", 1 + order_key() % 28, "日\t付款人民币1,", F.lpad((order_key() % 1000).cast("string"), 3, "0"), ",000.00元！！！！！　\n")
    return keyed(spark, d, v).select("id", text.clean_text(F.col("v")).alias("text"))


@query("ocr_line_filter", """SELECT o_orderkey AS id, '销售合同' || chr(10) || '编号 1' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || chr(10) || '正文' AS text FROM orders""")
def ocr_line_filter(spark, d):
    v = text_of("第 1 页\n12345\n销\n售\n合\n同\n编号 1", F.lpad(order_key().cast("string"), 8, "0"), "\nDRAFT copy\n- 3 -\n\n正文\n2/7")
    return keyed(spark, d, v).select("id", text.clean_ocr(F.col("v")).alias("text"))


@query("scan_repair", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '¥100,550.00 元 #' || o_orderkey WHEN 1 THEN '日期 2026-06-08 和 2026-08-04 和 2026-08-14 #' || o_orderkey ELSE '发票号码：263320000001' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS text,
 CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 1 END AS corrections FROM orders""")
def scan_repair(spark, d):
    """FN-36 to FN-39: misread amounts, dates of four forms, misread invoice numbers."""
    rows = keyed(spark, d, text_of("¥ 1O0,5S0.00 元 #", order_key()), text_of("日期 2026年6月8日 和 26-8-4 和 20260814 #", order_key()), text_of("发票号码：2633200OOOO1", F.lpad(order_key().cast("string"), 8, "0")))
    fixed = text.clean_scan(F.col("v"))
    return rows.select("id", fixed["text"].alias("text"), F.size(fixed["corrections"]).alias("corrections"))


RULES = [
    {"category": "letters", "keyword": "the", "match_type": "contains", "priority": 50, "weight": 1.5, "enabled": True},
    {"category": "letters", "keyword": "license", "match_type": "contains", "priority": 10, "weight": 2.0, "enabled": True},
    {"category": "notes", "keyword": "All rights reserved.", "match_type": "exact", "priority": 10, "weight": 1.0, "enabled": True},
    {"category": "mail", "keyword": "[a-z0-9.]+@[a-z0-9.]+", "match_type": "regex", "priority": 60, "weight": 1.25, "enabled": True},
    {"category": "mail", "keyword": "tel", "match_type": "contains", "priority": 10, "weight": 0.5, "enabled": True},
    {"category": "broken", "keyword": "(", "match_type": "regex", "priority": 10, "weight": 1.0, "enabled": True},
    {"category": "off", "keyword": "e", "match_type": "contains", "priority": 10, "weight": 1.0, "enabled": False},
]
HITS = f"""{with_(DOCS)}, h AS (
 SELECT id, 'letters' AS category, 'the' AS keyword, 1.5 AS weight, 1 AS high, 1 AS k FROM docs WHERE contains(extracted_text, 'the')
 UNION ALL SELECT id, 'letters', 'license', 2.0, 0, 2 FROM docs WHERE contains(extracted_text, 'license')
 UNION ALL SELECT id, 'notes', 'All rights reserved.', 1.0, 0, 1 FROM docs WHERE trim(extracted_text) = 'All rights reserved.' OR list_contains(string_split(extracted_text, chr(10)), 'All rights reserved.')
 UNION ALL SELECT id, 'mail', '[a-z0-9.]+@[a-z0-9.]+', 1.25, 1, 1 FROM docs WHERE regexp_matches(extracted_text, '[a-z0-9.]+@[a-z0-9.]+')
 UNION ALL SELECT id, 'mail', 'tel', 0.5, 0, 2 FROM docs WHERE contains(extracted_text, 'tel')),
 s AS (SELECT id, category, CAST(sum(weight) AS DECIMAL(22,3)) AS score, string_agg(keyword, '|' ORDER BY k) AS keywords, count(*) AS n, CAST(sum(high) AS BIGINT) AS high FROM h GROUP BY 1, 2)"""


@query("rule_scores", f"{HITS} SELECT id, category, CAST(score AS DOUBLE) AS score, keywords, n, high FROM s")
def rule_scores(spark, d):
    s = rules.rule_scores(t.documents(spark, d), RULES, "id", "extracted_text")
    return s.select("id", "category", F.col("score").cast("double").alias("score"), F.array_join("matched_keywords", "|").alias("keywords"), F.col("n_keywords").cast("long").alias("n"), F.col("priority_hits").cast("long").alias("high"))


CONF = "least(0.98, CASE n WHEN 1 THEN 0.6 WHEN 2 THEN 0.75 ELSE 0.85 END + least(0.05, greatest(0, (score - n) * 0.02)) + 0.04 * least(2, high))"


@query("best_rule", f"""{HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, high DESC, category) AS r FROM s)
 SELECT id, category, CAST(round(CAST({CONF} AS DECIMAL(20,6)), 4) AS DOUBLE) AS confidence FROM b WHERE r = 1""")
def best_rule(spark, d):
    s = rules.rule_scores(t.documents(spark, d), RULES, "id", "extracted_text")
    return rules.best_rule(s, "id").select("id", "category", F.col("confidence").cast("double").alias("confidence"))


@query("confidence_fusion", """WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_discount * 10 AS DECIMAL(6,2)) AS rule, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax * 10 AS DECIMAL(6,2)) END AS field, CASE WHEN l_linenumber % 3 = 0 THEN least(1.0, l_quantity / 25) END AS ai FROM lineitem),
 n AS (SELECT *, CAST(least(1, rule) * 100000000 AS BIGINT) * 40 + CASE WHEN field IS NULL THEN 0 ELSE CAST(least(1, field) * 100000000 AS BIGINT) * 20 END + coalesce(CAST(round(ai * 1e8) AS BIGINT) * 25, 0) AS v, 40 + CASE WHEN field IS NULL THEN 0 ELSE 20 END + CASE WHEN ai IS NULL THEN 0 ELSE 25 END AS w FROM c),
 s AS (SELECT *, (v * 2 + w * 10000) // (w * 20000) AS score FROM n)
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(score AS DECIMAL(10,4)) / 10000 AS score, CASE WHEN score >= 8500 THEN 'auto' WHEN score >= 6000 THEN 'review' ELSE 'reject' END AS decision FROM s""")
def confidence_fusion(spark, d):
    items = t.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    sources = {"rule": F.col("rule"), "field": F.col("field"), "keyword": F.lit(None).cast("double"), "ai": F.col("ai")}
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = items.select(*key, (F.col("l_discount") * 10).cast("decimal(6,2)").alias("rule"), F.when(n % 2 == 0, (F.col("l_tax") * 10).cast("decimal(6,2)")).alias("field"), F.when(n % 3 == 0, F.least(F.lit(1.0), F.col("l_quantity") / 25)).alias("ai"))
    score = classify.fused(sources)
    return rows.select(*key, score.cast("double").alias("score"), classify.decide(score).alias("decision"))


@query("rule_confidence", f"""WITH x AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_linenumber + l_quantity AS DECIMAL(20,6)) AS score, l_suppkey % 4 AS high FROM lineitem)
 SELECT DISTINCT l_orderkey, n, score, high, CAST(round(least(0.98, CAST(CASE n WHEN 1 THEN 0.6 WHEN 2 THEN 0.75 WHEN 3 THEN 0.85 ELSE least(0.95, 0.85 + 0.03 * (n - 3)) END AS DECIMAL(20,6)) + least(0.05, greatest(0, (score - n) * 0.02)) + 0.04 * least(2, high)), 4) AS DOUBLE) AS confidence FROM x""")
def rule_confidence(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), (F.col("l_linenumber") + F.col("l_quantity")).cast("decimal(20,6)").alias("score"), (F.col("l_suppkey") % 4).alias("high")).distinct()
    return rows.withColumn("confidence", classify.rule_confidence(F.col("n"), F.col("score"), F.col("high")).cast("double"))


@query("rule_simulation", f"""{HITS}, b AS (SELECT id, category, row_number() OVER (PARTITION BY id ORDER BY score DESC, high DESC, category) AS r FROM s),
 n AS (SELECT d.id, CASE document_type WHEN 'en' THEN 'letters' WHEN 'fr' THEN 'mail' ELSE '' END AS truth, category FROM (SELECT * FROM docs ORDER BY id DESC LIMIT 300) d LEFT JOIN b ON b.id = d.id AND r = 1)
 SELECT count(*) AS total, count(*) FILTER (category = truth) AS matched, count(*) FILTER (category IS NULL) AS unmatched, count(*) FILTER (category <> truth) AS misclassified,
 CAST(round(CAST(count(*) FILTER (category = truth) AS DECIMAL(18,6)) / nullif(count(category), 0), 4) AS DOUBLE) AS accuracy, CAST(round(CAST(count(category) AS DECIMAL(18,6)) / nullif(count(*), 0), 4) AS DOUBLE) AS coverage FROM n WHERE truth <> ''""")
def rule_simulation(spark, d):
    docs = t.documents(spark, d)
    best = rules.best_rule(rules.rule_scores(docs, RULES, "id", "extracted_text"), "id").select("id", F.col("category").alias("guess"))
    truth = F.when(F.col("document_type") == "en", "letters").when(F.col("document_type") == "fr", "mail").otherwise("")
    return rules.simulate(docs.withColumn("truth", truth).join(best, "id", "left"), "id", "truth", "guess", 300)


URL_RULES = [{"id": 1, "pattern": "/EN/", "category": "english", "priority": 10}, {"id": 2, "pattern": "(spam|pills)", "category": "bad", "priority": 100}, {"id": 3, "pattern": "(", "category": "broken", "priority": 200}]


@query("filename_rule", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(spam|pills)') THEN 2 WHEN regexp_matches(url, '(?i)/EN/') THEN 1 END AS rule_id, CASE WHEN regexp_matches(url, '(?i)(spam|pills)') THEN 'bad' WHEN regexp_matches(url, '(?i)/EN/') THEN 'english' END AS category FROM pages")
def filename_rule(spark, d):
    return rules.filename_rule(t.table(spark, d, "pages"), URL_RULES, "page_id", "url")


@query("field_extract", f"""{with_(DOCS)}, f AS (SELECT id, 'email' AS field, regexp_extract(extracted_text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]', 0) AS value FROM docs
 UNION ALL SELECT id, 'date', regexp_extract(extracted_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0) FROM docs UNION ALL SELECT id, 'phone', regexp_extract(extracted_text, '[+][0-9][0-9 -]{{6,}}[0-9]', 0) FROM docs
 UNION ALL SELECT id, 'token', regexp_extract(extracted_text, 'token = "([^"]*)"', 1) FROM docs) SELECT id, field, value FROM f WHERE value <> ''""")
def field_extract(spark, d):
    c = F.col("extracted_text")
    patterns = {"email": (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]", 0), "date": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), "phone": (r"[+][0-9][0-9 -]{6,}[0-9]", 0), "token": (r'token = "([^"]*)"', 1)}
    rows = F.array(*[F.struct(F.lit(k).alias("field"), extract.found(c, p, g).alias("value")) for k, (p, g) in patterns.items()])
    return t.documents(spark, d).select("id", F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))


FOUND = {
    0: [("company", "'上海华山贸易有限公司'", 0.9, "company_context"), ("date", "'2026-06-08'", 0.95, "date_context"), ("contract_no", "'HSYCXS（DD）-2026-' || n4", 0.85, "contract_context"), ("amount", "CAST(1000000 + k % 1000000 AS VARCHAR) || '.00'", 0.75, "amount_context"),
        ("vessel", "'伦敦勇士号'", 0.85, "vessel_context"), ("material", "'PB粉'", 0.8, "material_context"), ("quantity", "'10000'", 0.85, "quantity_context")],
    1: [("company", "'山西宏达钢铁有限公司'", 0.7, "company_generic"), ("seller", "'上海华山贸易有限公司'", 0.9, "seller_context"), ("date", "'2026-06-18'", 0.95, "date_context"), ("invoice_no", "'26332000000' || n9", 0.95, "invoice_no_anchor"),
        ("amount", "'81250.00'", 0.95, "invoice_amount_yuan"), ("quantity", "'100'", 0.9, "invoice_quantity_math")],
    2: [("company", "'山西宏达钢铁有限公司'", 0.9, "company_context"), ("date", "'2026-07-01'", 0.95, "date_context"), ("amount", "CAST(1000000 + k % 1000000 AS VARCHAR) || '.00'", 0.96, "receipt_amount_small"), ("summary", "'货款'", 0.85, "receipt_summary")],
    3: [("contract_no", "'SJWLCG（DD）-2026-' || n4", 0.6, "filename_contract"), ("vessel", "'海兴168'", 0.55, "filename_vessel"), ("material", "'铁矿粉'", 0.55, "filename_material")],
}
FOUND_SQL = " UNION ALL ".join(f"SELECT k AS id, '{field}' AS field, {value} AS value, {confidence} AS confidence, '{rule}' AS rule FROM o WHERE k % 4 = {kind}" for kind, rows in FOUND.items() for field, value, confidence, rule in rows)


@query("trade_fields", f"WITH o AS (SELECT c_custkey AS k, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS n4, lpad(CAST(c_custkey % 1000000000 AS VARCHAR), 9, '0') AS n9 FROM customer) {FOUND_SQL}")
def trade_fields(spark, d):
    """FX-01 to FX-14: a contract, an invoice, a receipt or a file name alone for each customer, with numbers and amounts of its own."""
    four, nine = F.lpad((customer_key() % 10000).cast("string"), 4, "0"), F.lpad((customer_key() % 1_000_000_000).cast("string"), 9, "0")
    amount = F.format_number((1_000_000 + customer_key() % 1_000_000).cast("decimal(18,2)"), 2)
    fill = lambda body, old, new: F.replace(F.lit(body), F.lit(old), new)
    contract = F.replace(fill(CONTRACT, "2026-0027", text_of("2026-", four)), F.lit("8,500,000.00"), amount)
    rows = keyed(spark, d, contract, fill(INVOICE, "26332000000123456789", text_of("26332000000", nine)), fill(RECEIPT, "1,500,000.00", amount), F.lit(""), table="customer", key="c_custkey")
    name = F.when(F.col("id") % 4 == 3, text_of("SJWLCG（DD）-2026-", F.lpad((F.col("id") % 10000).cast("string"), 4, "0"), "_海兴168船_铁矿粉.pdf")).otherwise("a.pdf")
    rows = rows.withColumn("name", name).repartition(4 * spark.sparkContext.defaultParallelism, "id")  # the table is small, but the rules take long
    return extract.extract(rows, "id", "v", "name").select("id", "field", "value", "confidence", "rule")


@query("field_conflicts", f"""{with_(FIELDS)}, c AS (SELECT document_id, field_name, field_value, row_number() OVER (PARTITION BY document_id ORDER BY field_value DESC, id) AS r FROM fields)
 SELECT document_id, field_value AS chosen, (SELECT string_agg(b.field_value, '|' ORDER BY b.field_value DESC) FROM fields b WHERE b.document_id = c.document_id AND b.field_value <> c.field_value) AS others FROM c WHERE r = 1""")
def field_conflicts(spark, d):
    own = F.sort_array(F.collect_set("field_value"), asc=False)
    rows = t.fields(spark, d).groupBy("document_id").agg(own.alias("v"))
    return rows.select("document_id", F.get("v", F.lit(0)).alias("chosen"), F.array_join(F.slice("v", F.lit(2), F.size("v")), "|").alias("others"))


@query("bigram_profile", f"""{with_(DOCS)}, c AS (SELECT document_type, regexp_extract_all(extracted_text, '[a-z]') AS l FROM docs), p AS (SELECT document_type, unnest(list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1])) AS gram FROM c),
 n AS (SELECT document_type, gram, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2) SELECT document_type, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY n DESC, gram) AS r FROM n) WHERE r <= 200""")
def bigram_profile(spark, d):
    return rules.bigrams(t.documents(spark, d), ["document_type"], "extracted_text", "[a-z]", "")


SAMPLES = [{"id": 1, "labels": {"the": 3, "license": 1}, "grams": {"th": 2, "zz": 2}, "fields": []}, {"id": 2, "labels": {"que": 2, "de": 2}, "grams": {"ci": 1}, "fields": ["x"]}]


@query("sample_match", f"""{with_(DOCS)}, s AS (SELECT id, CAST(round((CASE WHEN contains(extracted_text, 'the') THEN 3 ELSE 0 END + CASE WHEN contains(extracted_text, 'license') THEN 1 ELSE 0 END) / 4 * 0.35 + (CASE WHEN contains(extracted_text, 'th') THEN 2 ELSE 0 END + CASE WHEN contains(extracted_text, 'zz') THEN 2 ELSE 0 END) / 4 * 0.35, 6) AS DECIMAL(12,6)) AS a,
 CAST(round((CASE WHEN contains(extracted_text, 'que') THEN 2 ELSE 0 END + CASE WHEN contains(extracted_text, 'de') THEN 2 ELSE 0 END) / 4 * 0.35 + CASE WHEN contains(extracted_text, 'ci') THEN 0.35 ELSE 0 END, 6) AS DECIMAL(12,6)) AS b FROM docs)
 SELECT id, CAST(round(greatest(a, b), 4) AS DOUBLE) AS score, CASE WHEN greatest(a, b) >= 0.68 THEN CASE WHEN a >= b THEN 1 ELSE 2 END END AS sample_id FROM s""")
def sample_match(spark, d):
    return rules.sample_scores(t.documents(spark, d), SAMPLES, "id", "extracted_text").withColumn("score", F.col("score").cast("double"))


@query("label_counts", f"""{with_(DOCS)}, w AS (SELECT unnest(['the', 'de', 'license']) AS word) SELECT id, word, CAST((length(extracted_text) - length(replace(extracted_text, word, ''))) / length(word) AS INTEGER) AS n FROM docs, w WHERE contains(extracted_text, word)""")
def label_counts(spark, d):
    return rules.label_counts(t.documents(spark, d), "id", "extracted_text", ["the", "de", "license"])


@query("simhash", """WITH w AS (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations), h AS (SELECT conv_id, CAST('0x' || substr(md5(word), 1, 16) AS UBIGINT) AS h FROM w WHERE word <> ''),
 b AS (SELECT conv_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS i) GROUP BY 1, 2),
 f AS (SELECT conv_id, bit_or(CASE WHEN v > 0 THEN CAST(1 AS UBIGINT) << i ELSE CAST(0 AS UBIGINT) END) AS f FROM b GROUP BY 1) SELECT conv_id, lpad(lower(to_hex(f)), 16, '0') AS simhash FROM f""")
def simhash(spark, d):
    words = t.table(spark, d, "conversations").select("conv_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return hashing.simhash(words, ["conv_id"], "word")


@query("layout_hash", """WITH c AS (SELECT l_orderkey % 50 AS k, least(9, CAST(floor(l_quantity / 50 * 10) AS INTEGER)) + 10 * least(9, CAST(floor(l_discount / 0.1 * 10) AS INTEGER)) AS cell FROM lineitem),
 n AS (SELECT k, cell, least(9, count(*)) AS n FROM c GROUP BY 1, 2), g AS (SELECT k, i, coalesce(n, 0) AS n FROM (SELECT DISTINCT k FROM c) a, (SELECT unnest(range(100)) AS i) b LEFT JOIN n USING (k) WHERE cell = i OR cell IS NULL),
 full_ AS (SELECT a.k, b.i, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT k FROM c) a CROSS JOIN (SELECT unnest(range(100)) AS i) b LEFT JOIN n ON n.k = a.k AND n.cell = b.i) SELECT k, sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY i)) AS layout_hash FROM full_ GROUP BY 1""")
def layout_hash(spark, d):
    items = t.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.lit(50.0).alias("w"), F.lit(0.1).alias("h"))
    return hashing.layout_hash(items, "k", "x", "y", "w", "h")


@query("near_dup_pairs", """WITH w AS (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations), h AS (SELECT conv_id, CAST('0x' || substr(md5(word), 1, 16) AS UBIGINT) AS h FROM w WHERE word <> ''),
 b AS (SELECT conv_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS i) GROUP BY 1, 2),
 f AS (SELECT conv_id, bit_or(CASE WHEN v > 0 THEN CAST(1 AS UBIGINT) << i ELSE CAST(0 AS UBIGINT) END) AS f FROM b GROUP BY 1), u AS (SELECT f, min(conv_id) AS id FROM f GROUP BY 1)
 SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.f, b.f)) AS INTEGER) AS distance FROM u a JOIN u b ON a.id < b.id WHERE bit_count(xor(a.f, b.f)) <= 5""")
def near_dup_pairs(spark, d):
    return cluster.near_pairs(simhash(spark, d), "conv_id", "simhash")


@query("leader_clusters")
def leader_clusters(spark, d):
    """Conversations by fingerprint; a fifth of them share layouts."""
    layout = F.when(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0, F.concat(F.lit("L"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 50).cast("string")))
    prints = simhash(spark, d).select("conv_id", layout.alias("layout"), "simhash")
    return cluster.leader_clusters(prints, "conv_id", "layout", "simhash")


IMAGES = """p AS (SELECT p_partkey AS id, p_size AS w, CAST('0x' || substr(md5(p_brand), 1, 15) || substr('01234567', 1 + p_partkey % 8, 1) AS UBIGINT) AS h, CASE WHEN p_partkey % 3 > 0 THEN CAST(floor(p_retailprice / 500) AS DECIMAL(18,2)) END AS amount FROM part),
 m AS (SELECT id, min(id) OVER (PARTITION BY h, w, amount) AS class_id FROM p)"""


def images(spark, d):
    digit = F.substring(F.lit("01234567"), (F.col("p_partkey") % 8 + 1).cast("int"), F.lit(1))
    amount = F.when(F.col("p_partkey") % 3 > 0, F.floor(F.col("p_retailprice") / 500).cast("decimal(18,2)"))
    rows = t.table(spark, d, "part").select("p_partkey", F.concat(F.substring(F.md5(F.col("p_brand").cast("binary")), 1, 15), digit).alias("phash"), F.col("p_size").alias("img_w"), F.col("p_size").alias("img_h"), amount.alias("amount"))
    return cluster.same_image(rows, "p_partkey")


@query("same_image", f"""WITH {IMAGES}
 SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM p a JOIN p b ON a.id < b.id AND a.w = b.w JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id WHERE bit_count(xor(a.h, b.h)) <= 1 AND NOT coalesce(abs(a.amount - b.amount) >= 0.01, false) AND x.class_id < y.class_id""")
def same_image(spark, d):
    """Links between classes of equal pictures."""
    return images(spark, d)[1]


@query("same_image_classes", f"WITH {IMAGES} SELECT id, class_id FROM m")
def same_image_classes(spark, d):
    return images(spark, d)[0]


@query("cascading_groups", f"""{with_(DOCS)}, r AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'C' || (id % 7) ELSE '' END AS no, CASE WHEN id % 3 = 0 THEN document_type WHEN id % 3 = 1 THEN 'solo' || id ELSE '' END AS type, CASE WHEN id % 4 = 0 THEN source || ' company' ELSE '' END AS firm, substr(file_hash, 1, 16) AS body FROM docs),
 a AS (SELECT *, CASE WHEN no <> '' THEN 'contract:' || no END AS g FROM r), b AS (SELECT * REPLACE (coalesce(g, CASE WHEN type <> '' AND count(*) FILTER (g IS NULL) OVER (PARTITION BY type) >= 2 THEN 'type:' || type END) AS g) FROM a),
 c AS (SELECT * REPLACE (coalesce(g, CASE WHEN firm <> '' THEN 'company:' || firm END) AS g) FROM b), e AS (SELECT * REPLACE (coalesce(g, CASE WHEN count(*) FILTER (g IS NULL) OVER (PARTITION BY type, body) >= 2 THEN 'tpl:' || type || ':' || substr(body, 1, 6) END) AS g) FROM c)
 SELECT id, coalesce(g, 'single:' || id) AS group_key FROM e""")
def cascading_groups(spark, d):
    i = F.col("id")
    docs = t.documents(spark, d)
    no = F.when(i % 10 == 0, F.concat(F.lit("C"), (i % 7).cast("string"))).otherwise("")
    kind = F.when(i % 3 == 0, F.col("document_type")).when(i % 3 == 1, F.concat(F.lit("solo"), i.cast("string"))).otherwise("")
    firm = F.when(i % 4 == 0, F.concat("source", F.lit(" company"))).otherwise("")
    return cluster.cascading_groups(docs, "id", no, kind, firm, F.substring("file_hash", 1, 16))


@query("hash_duplicates", f"""{with_(DOCS)}, f AS (SELECT file_hash, min(id) AS first_id FROM docs WHERE status IN ('archived', 'need_review', 'duplicate') GROUP BY 1)
 SELECT id, CASE WHEN first_id <> id THEN first_id END AS duplicate_of FROM docs LEFT JOIN f USING (file_hash)""")
def hash_duplicates(spark, d):
    return eav.duplicates(t.documents(spark, d)).select("id", "duplicate_of")


@query("ingest_skip", f"""{with_(DOCS)} SELECT id FROM docs a WHERE NOT EXISTS (SELECT 1 FROM docs b WHERE b.status = 'archived' AND b.file_hash = a.file_hash AND b.source = a.source)""")
def ingest_skip(spark, d):
    docs = t.documents(spark, d)
    return eav.new_files(docs, docs.filter("status = 'archived'"), ["source", "file_hash"]).select("id")


@query("rename_render", f"""{with_(DOCS)} SELECT id, CASE WHEN status = 'archived' THEN 'ok_' ELSE upper(document_type) || '_' END || source || '_' || CAST(file_size AS VARCHAR) || '.txt' AS filename FROM docs""")
def rename_render(spark, d):
    pattern = "{{IF status == archived}}ok{{ELSE}}{document_type|upper}{{END}}_{source}_{missing}_{file_size:int}"
    docs = t.documents(spark, d)
    return docs.select("id", template.rendered(pattern, {c: F.col(c) for c in docs.columns}, F.lit(".TXT")).alias("filename"))


@query("archive_paths", f"""{with_(DOCS)} SELECT id, document_type || '/' || CASE WHEN id % 2 = 0 THEN '' ELSE source || '/' END || status AS path FROM docs""")
def archive_paths(spark, d):
    path = classify.archive_path([F.col("document_type"), F.when(F.col("id") % 2 == 0, "").otherwise(F.col("source")), F.col("status")])
    return t.documents(spark, d).select("id", path.alias("path"))


ROLES = [(1, "", "采购结算单", "a.pdf", ""), (2, "contract_up", "x", "y", ""), (3, "", "", "业财对账.xlsx", ""), (4, "", "增值税专用发票", "", ""), (5, "", "", "bank receipt.pdf", "保证金"), (6, "", "货权转移单", "", "退款"), (7, None, None, None, None), (8, "", "协议", "回单", "货款")]


@query("role_direction_nature", f"""{with_(values(ROLES, "k, role, type, name, summary"))}, z AS (SELECT o_orderkey AS id, lower(trim(coalesce(role, ''))) AS role, lower(coalesce(type, '') || ' ' || coalesce(name, '')) AS t, coalesce(name, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(type, '') AS s FROM orders JOIN x ON k = 1 + o_orderkey % 8)
 SELECT id, CASE WHEN role IN ('contract_up', 'contract_down', 'contract') THEN 'contract' WHEN contains(t, '对账') AND NOT contains(t, '结算单') THEN 'other' WHEN regexp_matches(t, '回单|水单|付款凭证|收款凭证|银行|payment|receipt') THEN 'payment_receipt'
 WHEN regexp_matches(t, '出库|货权|提单|放货|入库|cargo|waybill') THEN 'cargo_right' WHEN regexp_matches(t, '发票|invoice') THEN 'invoice' WHEN regexp_matches(t, '结算|对账|磅单|settlement') THEN 'settlement' WHEN regexp_matches(t, '合同|协议|contract|agreement') THEN 'contract' ELSE 'other' END AS role,
 CASE role WHEN 'contract_up' THEN 'up' WHEN 'contract_down' THEN 'down' ELSE 'unknown' END AS direction, CASE WHEN regexp_matches(s, '保证金|押金|定金|订金|履约金') THEN 'deposit' WHEN regexp_matches(s, '退款|退回|退还|返还|退货款') THEN 'refund' ELSE 'payment' END AS nature FROM z""")
def role_direction_nature(spark, d):
    """One of the cases for each order."""
    cases = literal(spark, ROLES, "k long, role string, type string, name string, summary string")
    rows = t.table(spark, d, "orders").select(order_key().alias("id"), (order_key() % 8 + 1).alias("k")).join(F.broadcast(cases), "k")
    c = F.col
    return rows.select("id", classify.infer_role(c("role"), c("type"), c("name")).alias("role"), classify.infer_direction(c("role"), F.lit("")).alias("direction"), classify.infer_nature(c("name"), c("summary"), c("type")).alias("nature"))


SEEDS = ", ".join(f"({k}, '{c}', '{w}')" for k, (c, w) in enumerate((c, w) for c, ws in seeds.KEYWORD_RULES.items() for w in ws))


@query("seed_rules", f"""{with_(values(TEXTS, "id, v, name"))}, d AS (SELECT o_orderkey, v || ' ' || o_orderkey || name AS v FROM orders JOIN x ON id = 1 + o_orderkey % 5)
 SELECT o_orderkey, c AS category, count(*) AS n, string_agg(w, '|' ORDER BY k) AS keywords FROM d, (VALUES {SEEDS}) r(k, c, w) WHERE contains(v, w) GROUP BY 1, 2""")
def seed_rules(spark, d):
    """A fixture text for each order, by the rules that a new installation has."""
    x = literal(spark, TEXTS, "id int, v string, name string")
    docs = t.table(spark, d, "orders").withColumn("id", (F.col("o_orderkey") % 5 + 1).cast("int")).join(F.broadcast(x), "id").select("o_orderkey", F.concat("v", F.lit(" "), F.col("o_orderkey").cast("string"), "name").alias("v"))
    s = rules.rule_scores(docs, seeds.keyword_rules(), "o_orderkey", "v")
    return s.select("o_orderkey", "category", F.col("n_keywords").cast("long").alias("n"), F.array_join("matched_keywords", "|").alias("keywords"))


SEED_PATHS = [f"{p}/{c}" if c else p for p, cs in seeds.CATEGORY_TREE.items() for c in ["", *cs]]


@query("seed_categories", "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {repr(p.split('/')[0]) if '/' in p else 'NULL'}, '{p}')" for k, p in enumerate(SEED_PATHS, 1)) + f""") v(id, parent, path))
 SELECT parent, path, count(o_orderkey) AS n FROM v LEFT JOIN orders ON 1 + o_orderkey % {len(SEED_PATHS)} = id GROUP BY 1, 2""")
def seed_categories(spark, d):
    """SRC-20: the category tree with the number of orders that are filed under each category."""
    rows = seeds.categories(spark)
    filed = t.table(spark, d, "orders").groupBy((F.col("o_orderkey") % len(SEED_PATHS) + 1).alias("id")).agg(F.count("*").alias("n"))
    named = rows.join(rows.select(F.col("id").alias("parent_id"), F.col("path").alias("parent")), "parent_id", "left")
    return named.join(filed, "id", "left").select("parent", "path", F.coalesce("n", F.lit(0)).alias("n"))


@query("fuzzy_guard", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'invalid' ELSE 'linked' END AS outcome, CASE WHEN s_suppkey % 4 < 3 THEN 'HSYCXS-2026-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS known_no,
 CASE s_suppkey % 4 WHEN 2 THEN CAST(17 AS DOUBLE) / 18 WHEN 3 THEN NULL ELSE 1.0 END AS score FROM supplier""")
def fuzzy_guard(spark, d):
    """Numbers of all suppliers, asked for as they are, in full width, with a misread prefix (others are almost as near), or not at all."""
    k = F.col("s_suppkey")
    no = F.concat(F.lit("-2026-"), F.lpad(k.cast("string"), 6, "0"))
    asked = F.when(k % 4 == 0, F.concat(F.lit("HSYCXS"), no)).when(k % 4 == 1, F.translate(F.concat(F.lit("hsycxs"), no), "-2", "－２")).when(k % 4 == 2, F.concat(F.lit("H5YCXS"), no)).otherwise("SDJZ-SXJG2026")
    rows = t.table(spark, d, "supplier")
    return dossier.fuzzy_guard(rows.select(k.alias("id"), asked.alias("no")), rows.select(k.alias("id"), F.concat(F.lit("HSYCXS"), no).alias("no")), "no", "id")


@query("company_fix", """WITH n AS (SELECT n_name || '钢铁贸易有限公' AS stem, length(replace(replace(n_name, ' ', ''), '_', '')) + 8 AS n FROM nation) SELECT stem || '可' AS candidate, stem || '司' AS best, (n - 1.0) / n AS score FROM n WHERE (n - 1.0) / n >= 0.85""")
def company_fix(spark, d):
    """A company for each nation, its last character misread."""
    stem = F.concat("n_name", F.lit("钢铁贸易有限公"))
    rows = t.table(spark, d, "nation")
    return dossier.company_fix(rows.select(F.concat(stem, F.lit("可")).alias("v")), rows.select(F.concat(stem, F.lit("司")).alias("v")), "v", "v")


@query("provider_answers", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_orderkey % 7 AS k FROM orders)
 SELECT id, CASE WHEN k IN (0, 1, 2) THEN kind END AS document_type, CASE WHEN k IN (0, 1, 2) THEN 0.9 END AS confidence,
 CASE k WHEN 3 THEN 'ConnectionError: call 3' WHEN 4 THEN 'ValueError: the answer holds no object' WHEN 5 THEN 'ValueError: not a confidence: 1.5' WHEN 6 THEN 'RuntimeError: broken' END AS error,
 CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 6 THEN 1 ELSE 3 END AS INT) AS calls FROM o""")
def provider_answers(spark, d):
    """SRC-21, UDF-07, FN-81, FN-82: each order's text through a provider that answers, fails once or more, or answers nonsense."""
    k = F.col("id") % 7
    rule = F.when(k == 0, "").when(k == 1, "fail: 1").when(k == 2, "fail: 2").when(k == 3, "fail: 9").when(k == 4, "bad").when(k == 5, "wild").otherwise("odd")
    rows = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    text = F.concat(F.lit("order "), F.col("id").cast("string"), F.lit(" type: "), F.col("kind"), F.lit(" "), rule)
    got = written(provider.asked(rows, "id", text, provider.Fake), "answers").withColumn("a", files.answer(F.col("answer")))
    return got.select("id", "a.document_type", "a.confidence", "error", "calls")


@query("order_fields", """WITH o AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS n8, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS n4 FROM orders)
 SELECT id, 'order_no' AS field, 'PO-' || n8 AS value, 'order_context' AS rule, '' AS conflicts FROM o UNION ALL SELECT id, 'contract_suffix', n4, 'contract_suffix_yc', '' FROM o
 UNION ALL SELECT id, 'amount', '3' || n4 || '.50', 'amount_total', '2' || n4 || '|1' || n4 FROM o""")
def order_fields(spark, d):
    """FX-05, FX-06, FX-08: order numbers and suffixes of contract numbers, and an amount with others that contradict it."""
    four = F.lpad((order_key() % 10000).cast("string"), 4, "0")
    v = text_of("订单编号：PO-", F.lpad(order_key().cast("string"), 8, "0"), "\nYC-", four, "\n合计金额 3", four, ".50\n人民币2", four, "\n另付 1", four, " 元\n")
    found = extract.extract(keyed(spark, d, v), "id", "v", clean=False)
    return found.filter(F.col("field").isin("order_no", "contract_suffix", "amount")).select("id", "field", "value", "rule", F.array_join("conflicts", "|").alias("conflicts"))
