"""Queries of scalar functions, imports, lookups of ledgers and changes, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import classify, money, text
from ..operators import dossier, eav, ledger, lifecycle, recon, rules
from ..sources import tables as t
from .catalogue import DOCS, LEDGER, OPS, query, with_
from .linking import LOOSE


def orders(spark, d):
    return t.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")


@query("bare_keys", r"""SELECT p_partkey AS id, replace(format('{:,}', p_partkey * 1000), ',', '') AS quantity, upper(regexp_replace(p_type || ' (' || p_size || ') 号', '[^\p{L}\p{N}]', '', 'g')) AS skeleton,
 regexp_replace(p_name || '（' || p_brand || '）：', '[\s，,。；;：:（）()\-_/]', '', 'g') AS company, lower(regexp_replace(p_type, '\s+', '', 'g')) AS kind FROM part""")
def bare_keys(spark, d):
    rows, c = t.table(spark, d, "part"), F.col
    quantity = F.concat(F.lit(" "), F.format_number(c("p_partkey") * 1000, 0), F.lit(" "))
    return rows.select(c("p_partkey").alias("id"), text.norm_quantity(quantity).alias("quantity"), text.alnum(F.concat("p_type", F.lit(" ("), c("p_size").cast("string"), F.lit(") 号"))).alias("skeleton"), text.norm_company(F.concat("p_name", F.lit("（"), "p_brand", F.lit("）："))).alias("company"), text.norm_type(c("p_type")).alias("kind"))


@query("content_hashes", r"SELECT doc_id, CASE WHEN b = '' THEN '' ELSE substr(sha256(b), 1, 16) END AS hash FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS b FROM documents)")
def content_hashes(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("chars_apart", """SELECT o_orderkey AS id, CASE WHEN length(a) = length(b) THEN list_sum([CASE WHEN substr(a, i, 1) = substr(b, i, 1) THEN 0 ELSE 1 END for i in range(1, length(a) + 1)]) END AS n
 FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey * 7 AS VARCHAR) AS b FROM orders)""")
def chars_apart(spark, d):
    return orders(spark, d).select("id", text.chars_differ(F.col("id").cast("string"), (F.col("o_custkey") * 7).cast("string")).alias("n"))


@query("head_and_tail", "SELECT doc_id, CASE WHEN length(text) > 1500 THEN sha256(left(text, 1000) || chr(10) || '…' || chr(10) || right(text, 500)) ELSE sha256(text) END AS cut FROM documents")
def head_and_tail(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.sha2(text.head_and_tail(F.col("text")), 256).alias("cut"))


@query("safe_paths", "SELECT o_orderkey AS id, o_orderkey % 5 IN (0, 4) AS safe FROM orders")
def safe_paths(spark, d):
    k = F.col("id").cast("string")
    path = F.element_at(F.array(F.concat(F.lit("a/b.."), k), F.concat(F.lit("/etc/"), k), F.concat(F.lit("a/../"), k), F.concat(F.lit("C:\\"), k), F.concat(k, F.lit("/..x/y"))), (F.col("id") % 5 + 1).cast("int"))
    return orders(spark, d).select("id", text.is_safe_path(path).alias("safe"))


@query("file_numbers", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'HSYCXS-2026-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') ELSE '' END AS no FROM orders")
def file_numbers(spark, d):
    """Half of the file names bear a valid business number."""
    k = F.lpad(F.col("id").cast("string"), 6, "0")
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("销售合同 HSYCXS-2026-"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("scan"), k, F.lit(".pdf")))
    return orders(spark, d).select("id", text.no_from_filename(name).alias("no"))


@query("detail_amounts", "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, strftime(o_orderdate, '%Y-%m') AS period, CASE o_orderkey % 4 WHEN 0 THEN 'payment' WHEN 1 THEN 'receipt' WHEN 2 THEN 'payment' ELSE 'receipt' END AS kind FROM orders")
def detail_amounts(spark, d):
    k, day = F.col("id") % 4, F.col("o_orderdate").cast("date")
    words = F.when(k == 0, "已付款").when(k == 1, "Receipt of goods")
    return orders(spark, d).select("id", money.detail_amount(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("amount"), money.period(F.when(k > 1, day), day).alias("period"), money.detail_kind(words, F.when(k == 2, -1).otherwise(1)).alias("kind"))


TYPES = ", ".join(f"('{k}', '{v}')" for k, v in config.TYPE_ROLES.items())


@query("file_roles", f"WITH r AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {TYPES}) v(type, role)), n AS (SELECT count(*) AS n FROM r) SELECT o_orderkey AS id, coalesce(role, 'other') AS role FROM orders CROSS JOIN n LEFT JOIN r ON k = o_orderkey % (n + 1)")
def file_roles(spark, d):
    names = [*config.TYPE_ROLES, "没有"]
    kind = F.element_at(F.array(*[F.lit(f" {n} ") for n in names]), (F.col("id") % len(names) + 1).cast("int"))
    return orders(spark, d).select("id", classify.file_role(kind).alias("role"))


@query("suggested_types", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax * 10 >= 0.7 AND l_returnflag <> 'N' THEN l_returnflag WHEN l_linestatus <> 'O' THEN l_linestatus WHEN l_returnflag = 'N' THEN '其他' ELSE l_returnflag END AS kind, least(1.0, l_linenumber / 5) AS confidence FROM lineitem""")
def suggested_types(spark, d):
    ai = F.when(F.col("l_returnflag") == "N", config.OTHER_TYPE).otherwise(F.col("l_returnflag"))
    rule = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    rows = t.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", classify.suggested_type(rule, ai, F.col("l_tax") * 10).alias("kind"), classify.keyword_confidence(F.col("l_linenumber")).alias("confidence"))


@query("anchor_list", f"{with_(LEDGER, LOOSE)} SELECT business_no, k AS rank, d AS direction, v AS anchor FROM fresh")
def anchor_list(spark, d):
    return recon.anchors(t.ledger(spark, d))


@query("cargo_receivers", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '甲' || o_orderkey || '有限公司' WHEN 1 THEN '乙' || o_orderkey || '股份有限公司' ELSE '' END AS receiver FROM orders")
def cargo_receivers(spark, d):
    k = F.col("id").cast("string")
    body = F.when(F.col("id") % 3 == 0, F.concat(F.lit("收货\n公司名称： 甲"), k, F.lit("有限公司，地址"))).when(F.col("id") % 3 == 1, F.concat(F.lit("货权转移给下列“乙"), k, F.lit("股份有限公司”。"))).otherwise("无")
    return orders(spark, d).select("id", classify.cargo_receiver(body).alias("receiver"))


@query("backfilled_lines", """SELECT CAST(o_orderkey AS VARCHAR) AS business_no, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS up_settlement, o_orderkey % 4 = 3 AS settlement_missing, o_orderkey % 5 > 0 AS payment_missing,
 CASE WHEN o_orderkey % 2 = 0 THEN 'U' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'P' || o_orderkey END AS up_contract_no FROM orders""")
def backfilled_lines(spark, d):
    """Settlements of three quarters of the lines, by the second variant for half of these; payments of a fifth, which know a number."""
    rows, k = orders(spark, d), F.col("id")
    no = k.cast("string")
    lines = rows.select(no.alias("business_no"), F.when(k % 2 == 0, F.concat(F.lit("U"), no)).otherwise("").alias("up_contract_no"))
    variants = rows.select(no.alias("business_no"), F.posexplode(F.array(F.concat(F.lit("A"), no), F.concat(F.lit("B"), no))).alias("position", "contract_key"))
    settlement = rows.filter(k % 4 < 3).select(F.concat(F.when(k % 2 == 0, "A").otherwise("B"), no).alias("contract_key"), F.col("o_totalprice").cast("decimal(18,2)").alias("up_settlement"))
    payment = rows.filter(k % 5 == 0).select(F.concat(F.lit("B"), no).alias("contract_key"), F.concat(F.lit("P"), no).alias("up_contract_no"))
    return ledger.backfilled(lines, settlement, payment, variants).select("business_no", "up_settlement", "settlement_missing", "payment_missing", "up_contract_no")


@query("enriched_lists", "SELECT CAST(o_orderkey AS VARCHAR) AS business_no, CASE WHEN o_orderkey % 3 = 0 THEN 'a,b,c' ELSE 'a,b' END AS numbers FROM orders")
def enriched_lists(spark, d):
    main = orders(spark, d).select(F.col("id").cast("string").alias("business_no"), F.array(F.lit("a"), F.lit("b")).alias("numbers"))
    extra = main.filter("CAST(business_no AS BIGINT) % 3 = 0").select("business_no", F.array(F.lit("b"), F.lit("c")).alias("numbers"))
    return ledger.enrich(main, extra.union(spark.createDataFrame([("none", ["z"])], extra.schema)), "business_no", ["numbers"]).select("business_no", F.array_join("numbers", ",").alias("numbers"))


@query("imported_details", """SELECT o_orderkey % 3 = 0 AS skipped, CASE WHEN o_orderkey % 3 > 0 OR o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS business_no, CASE WHEN o_orderkey % 3 > 0 OR o_orderkey % 2 = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
 CASE WHEN o_orderkey % 2 = 1 THEN 'payment' ELSE 'receipt' END AS kind, CAST(o_orderdate AS DATE) AS occurred_on FROM orders""")
def imported_details(spark, d):
    """A third of the rows lacks number or amount; odd ones are negative, so payments."""
    k = F.col("id")
    price = F.concat(F.when(k % 2 == 1, "-").otherwise(""), F.format_number("o_totalprice", 2))
    rows = orders(spark, d).select(F.when((k % 3 == 0) & (k % 2 == 1), " ").otherwise(k.cast("string")).alias("编号"), F.when((k % 3 == 0) & (k % 2 == 0), "x").otherwise(price).alias("金额"), F.date_format("o_orderdate", "yyyy年M月d日").alias("日期"))
    good, bad = ledger.import_details(rows, "b1", {"business_no": "编号", "amount": "金额", "occurred_on": "日期"})
    columns = ["business_no", "amount", "kind", "occurred_on"]
    return good.select(F.lit(False).alias("skipped"), *columns).union(bad.select(F.lit(True).alias("skipped"), *columns))


@query("template_match", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 1 END AS template_id FROM orders WHERE o_orderkey % 3 < 2""")
def template_match(spark, d):
    """Templates of one type: the more used one asks for two fields."""
    templates = spark.createDataFrame([(1, "t", ["a"], 5, True), (2, "t", ["a", "b"], 9, True), (3, "t", [], 99, False)], "template_id int, document_type string, require_fields array<string>, usage_count int, enabled boolean")
    k = F.col("id") % 3
    own = F.when(k == 0, F.array(F.lit("b"), F.lit("a"))).when(k == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return rules.template_match(orders(spark, d).select("id", F.lit("t").alias("document_type"), own.alias("own")), templates, "id", "document_type", "own")


@query("learned_fields", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b,c' ELSE 'a,c' END AS fields FROM orders")
def learned_fields(spark, d):
    old = F.when(F.col("id") % 2 == 0, F.array(F.lit("b"), F.lit("a")))
    return orders(spark, d).select("id", F.array_join(rules.learned(old, F.array(F.lit("c"), F.lit("a"))), ",").alias("fields"))


@query("ingest_outcomes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'duplicate' WHEN o_orderkey % 2 = 0 THEN 'archived' ELSE 'need_review' END AS status FROM orders")
def ingest_outcomes(spark, d):
    k = F.col("id")
    return orders(spark, d).select("id", lifecycle.outcome(F.when(k % 2 == 0, "auto").otherwise("review"), F.when(k % 5 == 0, 1), F.when(k % 7 == 0, "e")).alias("status"))


@query("restored_documents", f"{with_(DOCS)} SELECT id, CASE WHEN id % 10 = 5 THEN 'recycled' ELSE status END AS status FROM docs")
def restored_documents(spark, d):
    """Every fifth document is recycled, and every tenth comes back."""
    docs = t.documents(spark, d).select("id", "status")
    now, bin_ = lifecycle.recycle(docs, docs.filter("id % 5 = 0").select("id"), "x", F.lit("2026-01-01").cast("timestamp"))
    return lifecycle.restore(now, bin_, docs.filter("id % 10 = 0").select("id"))[0].select("id", "status")


@query("undone_documents", f"""{with_(OPS)}, u AS (SELECT job_id AS id, max_by(id, (created_at, id)) AS op FROM ops WHERE operation_type IN ('click', 'view') AND result = 'ok' GROUP BY 1)
 SELECT c_custkey AS id, CASE WHEN op IS NULL THEN 'now' ELSE 'old-' || op END AS current_filename FROM customer LEFT JOIN u ON u.id = c_custkey""")
def undone_documents(spark, d):
    log = t.operations(spark, d).withColumn("document_id", F.col("job_id"))
    back = lifecycle.last_reversible(log, ["click", "view"]).select("document_id", F.concat(F.lit("old-"), F.col("id").cast("string")).alias("old_filename"), F.lit(None).cast("string").alias("old_status"))
    docs = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("now").alias("current_filename"), F.lit("archived").alias("status"))
    return lifecycle.undone(docs, back).select("id", "current_filename")


@query("category_errors", "SELECT n_nationkey AS id, 'path exists' AS error FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT n_regionkey + 1000, 'has children' FROM nation")
def category_errors(spark, d):
    """New names of nations that are taken, and the deletion of regions that have nations."""
    rows = t.categories(spark, d).select((F.col("id") + F.when(F.col("parent_id").isNull(), 1000).otherwise(0)).alias("id"), (F.col("parent_id") + 1000).alias("parent_id"), "name")
    taken = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("new").alias("name"), F.lit(False).alias("delete"))
    gone = t.table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.lit(True).alias("delete"))
    return lifecycle.category_errors(rows, taken.union(gone))


@query("resolved_diffs", "SELECT CAST(o_orderkey AS VARCHAR) AS business_no, CASE WHEN o_orderkey = 1 THEN 'ignore' WHEN o_orderkey % 2 = 0 THEN 'pending' END AS resolution FROM orders")
def resolved_diffs(spark, d):
    diffs = orders(spark, d).select(F.col("id").cast("string").alias("business_no"), F.lit("k").alias("key"), F.when(F.col("id") % 2 == 0, "pending").alias("resolution"))
    return recon.resolve(diffs, "1", "k", "ignore").select("business_no", "resolution")


@query("written_fields", """SELECT o_orderkey AS document_id, 'amount' AS field_name, CAST(o_custkey AS VARCHAR) AS field_value FROM orders UNION ALL SELECT o_orderkey, 'suggested_category', o_orderpriority FROM orders""")
def written_fields(spark, d):
    rows = orders(spark, d).select("id", F.lit("amount").alias("field"), F.col("o_custkey").cast("string").alias("value"), F.lit(0.5).alias("confidence"), F.lit("RULE").alias("source"), F.col("o_orderpriority").alias("category"))
    return eav.field_rows(rows, "id", "category").select("document_id", "field_name", "field_value")


def links(spark, d):
    """Lines as links of an order's dossier with a part's document, each once."""
    return t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("business_id"), F.col("l_partkey").alias("document_id")).distinct()


@query("unlinked_files", "SELECT DISTINCT l_orderkey AS business_id, l_partkey AS document_id FROM lineitem WHERE l_partkey % 4 > 0 OR l_orderkey % 2 = 0")
def unlinked_files(spark, d):
    files = links(spark, d)
    return dossier.unlinked(files, files.filter("document_id % 4 = 0 AND business_id % 2 = 1"))


@query("dissolved_dossiers", "SELECT 'record' AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'link', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")
def dissolved_dossiers(spark, d):
    rows = orders(spark, d)
    records, files = dossier.dissolved(rows.select("id"), links(spark, d), rows.filter("o_orderstatus = 'F'").select("id"))
    return records.agg(F.count("*").alias("n")).select(F.lit("record").alias("kind"), "n").union(files.agg(F.count("*").alias("n")).select(F.lit("link"), "n"))


@query("dossier_documents", "SELECT DISTINCT l_orderkey AS business_id, l_partkey AS document_id, 'B' || l_orderkey AS business_no, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def dossier_documents(spark, d):
    records = orders(spark, d).select("id", F.concat(F.lit("B"), F.col("id").cast("string")).alias("business_no"))
    docs = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return dossier.documents_of(links(spark, d), docs, records)


@query("learned_samples", """WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]') AS l FROM documents), p AS (SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1])) AS gram FROM c), n AS (SELECT doc_id, gram, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
 g AS (SELECT doc_id, count(*) AS grams FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM n) WHERE r <= 50 GROUP BY 1)
 SELECT d.doc_id, coalesce(grams, 0) AS grams, CASE WHEN contains(coalesce(text, ''), 'the') THEN CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) END AS the FROM documents d LEFT JOIN g USING (doc_id)""")
def learned_samples(spark, d):
    got = rules.learned_sample(t.table(spark, d, "documents"), "doc_id", "text", ["the", "de"], "[a-z]", "", 50)
    return got.select("doc_id", F.size("grams").cast("long").alias("grams"), F.try_element_at("labels", F.lit("the")).alias("the"))
