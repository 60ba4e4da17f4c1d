"""Queries of the relational core: dashboards, library, fields, dossiers, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard, dossier, eav, ledger, lifecycle, recon
from ..sources import tables as t
from .catalogue import DETAILS, DOCS, FIELDS, LEDGER, LINES, OPS, query, with_

LAST = "(SELECT max(CAST(ts AS DATE)) FROM events)"


def day():
    return F.to_date("created_at")


@query("daily_trend", f"""{with_(OPS)}, cal AS (SELECT CAST(unnest(generate_series({LAST} - 29, {LAST}, INTERVAL 1 DAY)) AS DATE) AS day),
 c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (result = 'ok') AS ok, count(*) FILTER (result = 'failed') AS failed FROM ops GROUP BY 1)
 SELECT day, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, CAST(round(CAST(ok AS DECIMAL(18,6)) / nullif(total, 0), 4) AS DOUBLE) AS success_rate
 FROM cal LEFT JOIN c USING (day)""")
def daily_trend(spark, d):
    ops = t.operations(spark, d)
    return dashboard.daily_trend(ops, day(), F.col("result") == "ok", F.col("result") == "failed", dashboard.as_of(ops), 30)


@query("ocr_daily", f"""{with_(OPS)}, cal AS (SELECT CAST(unnest(generate_series({LAST} - 6, {LAST}, INTERVAL 1 DAY)) AS DATE) AS day),
 c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (value >= 50) AS ok, count(*) FILTER (value < 50) AS failed FROM ops WHERE operation_type = 'view' GROUP BY 1)
 SELECT day, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, CAST(round(CAST(ok AS DECIMAL(18,6)) / nullif(total, 0), 4) AS DOUBLE) AS success_rate
 FROM cal LEFT JOIN c USING (day)""")
def ocr_daily(spark, d):
    ops = t.operations(spark, d)
    return dashboard.daily_trend(ops.filter("operation_type = 'view'"), day(), F.col("value") >= 50, F.col("value") < 50, dashboard.as_of(ops), 7)


@query("type_surge_alerts", f"""{with_(OPS)}, w AS (SELECT operation_type || '-' || (job_id % 50) AS type,
 count(*) FILTER (date_diff('day', CAST(created_at AS DATE), {LAST}) BETWEEN 0 AND 6) AS last7,
 count(*) FILTER (date_diff('day', CAST(created_at AS DATE), {LAST}) BETWEEN 7 AND 13) AS prev7 FROM ops GROUP BY 1)
 SELECT * FROM w WHERE last7 >= 5 AND (prev7 = 0 OR last7 >= 3 * prev7)""")
def type_surge_alerts(spark, d):
    ops = t.operations(spark, d)
    kinds = ops.withColumn("kind", F.concat_ws("-", "operation_type", (F.col("job_id") % 50).cast("string")))
    return dashboard.surges(kinds, "kind", day(), dashboard.as_of(ops))


@query("fail_alerts", f"""{with_(OPS)}, n AS (SELECT date_diff('day', CAST(created_at AS DATE), {LAST}) AS age, value >= 50 AS bad FROM ops),
 a AS (SELECT 'today' AS alert, count(*) FILTER (age = 0) AS total, count(*) FILTER (age = 0 AND bad) AS failed FROM n
       UNION ALL SELECT 'week', count(*) FILTER (age BETWEEN 0 AND 6), count(*) FILTER (age BETWEEN 0 AND 6 AND bad) FROM n),
 r AS (SELECT *, CAST(round(CAST(failed AS DECIMAL(18,6)) / nullif(total, 0), 4) AS DOUBLE) AS rate FROM a)
 SELECT * FROM r WHERE (alert = 'today' AND failed >= 1 AND rate >= 0.3) OR (alert = 'week' AND total >= 5 AND failed >= 3 AND rate >= 0.2)""")
def fail_alerts(spark, d):
    ops = t.operations(spark, d)
    return dashboard.fail_alerts(ops, day(), F.col("value") >= 50, dashboard.as_of(ops))


@query("dashboard_counts", """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS archived, count(*) FILTER (o_orderstatus = 'O') AS need_review,
 count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS today FROM orders""")
def dashboard_counts(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "need_review").otherwise("failed")
    docs = t.table(spark, d, "orders").select(status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return dashboard.counts(docs, dashboard.as_of(docs))


@query("type_counts", f"{with_(DOCS)} SELECT coalesce(nullif(trim(document_type), ''), '未识别') AS type, count(*) AS n FROM docs GROUP BY 1")
def type_counts(spark, d):
    return dashboard.by_type(t.documents(spark, d))


@query("library_page", f"""{with_(DOCS)} SELECT id, original_filename, document_type, status FROM docs WHERE status = 'archived' AND document_type ILIKE '%e%'
 ORDER BY file_size DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10""")
def library_page(spark, d):
    docs = t.documents(spark, d).withColumn("created_at", F.col("file_size"))
    return eav.library(docs, "archived", "e", 50, 10).select("id", "original_filename", "document_type", "status")


@query("keyword_search", f"""{with_(DOCS, FIELDS)} SELECT id, original_filename FROM docs
 WHERE original_filename ILIKE '%src1%' OR document_type ILIKE '%src1%' OR id IN (SELECT document_id FROM fields WHERE field_value ILIKE '%src1%') OR document_type IN ('fr')""")
def keyword_search(spark, d):
    return eav.keyword_search(t.documents(spark, d), t.fields(spark, d), "src1", ["fr"]).select("id", "original_filename")


@query("eav_filter_range", f"""{with_(FIELDS)} SELECT DISTINCT document_id FROM fields WHERE field_name IN ('amount', 'total_amount')
 AND contains(field_value, '9') AND TRY_CAST(replace(field_value, ',', '') AS DECIMAL(24,6)) BETWEEN 1000 AND 90000""")
def eav_filter_range(spark, d):
    return eav.matching(t.fields(spark, d), ["amount", "total_amount"], "9", 1000, 90000)


@query("date_or_filter", f"""{with_(FIELDS)} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN
 (SELECT document_id FROM fields WHERE field_name IN ('date') AND field_value >= '1996-01-01' AND field_value <= '1996-06-30')
 OR (o_orderkey % 3 = 0 AND (strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' OR strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30'))""")
def date_or_filter(spark, d):
    """Two thirds of the documents don't say when they were created, so only their fields count."""
    docs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("created_at"))
    return eav.date_search(docs, t.fields(spark, d), ["date"], "1996-01-01", "1996-06-30").select("id")


@query("log_filter", f"{with_(OPS)} SELECT id, operation_type, result FROM ops WHERE operation_type = 'error' ORDER BY id DESC LIMIT 100 OFFSET 20")
def log_filter(spark, d):
    return lifecycle.log_page(t.operations(spark, d), "error", limit=100, offset=20).select("id", "operation_type", "result")


@query("suggestions", f"""{with_(DOCS, FIELDS)}, s AS (
 SELECT * FROM (SELECT 'type' AS label, document_type AS text, 0 AS s, row_number() OVER (ORDER BY document_type) AS n FROM (SELECT DISTINCT document_type FROM docs WHERE document_type ILIKE '%e%') ORDER BY text LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 'field', field_value, 1, row_number() OVER (ORDER BY field_value) FROM (SELECT DISTINCT field_value FROM fields WHERE field_value ILIKE '%e%') ORDER BY 2 LIMIT 30)
 UNION ALL SELECT * FROM (SELECT 'file', original_filename, 2, row_number() OVER (ORDER BY id DESC) FROM docs WHERE original_filename ILIKE '%e%' ORDER BY id DESC LIMIT 10))
 SELECT label, text FROM s ORDER BY s, n LIMIT 20""")
def suggestions(spark, d):
    return eav.suggestions(t.documents(spark, d), t.fields(spark, d), "e")


@query("distinct_categories", f"{with_(FIELDS)} SELECT DISTINCT field_value AS category FROM fields JOIN orders ON o_orderkey = document_id WHERE field_name = 'category' AND field_value <> ''")
def distinct_categories(spark, d):
    rows = t.fields(spark, d).filter("field_name = 'category' AND field_value <> ''")
    return rows.join(t.table(spark, d, "orders"), F.col("document_id") == F.col("o_orderkey")).select(F.col("field_value").alias("category")).distinct()


@query("eav_pivot_latest", f"""{with_(FIELDS)} SELECT document_id, arg_max(field_value, id) FILTER (field_name IN ('amount', 'price')) AS amount,
 arg_max(field_value, id) FILTER (field_name IN ('date')) AS date, arg_max(field_value, id) FILTER (field_name IN ('status', 'category')) AS state
 FROM fields WHERE field_name IN ('amount', 'price', 'date', 'status', 'category') AND field_value <> '' GROUP BY 1""")
def eav_pivot_latest(spark, d):
    return eav.pivot(t.fields(spark, d), {"amount": ["amount", "price"], "date": ["date"], "state": ["status", "category"]})


@query("doc_fields_nested", f"""{with_(FIELDS)} SELECT o_orderkey AS id, string_agg(field_name || '=' || field_value, ';' ORDER BY field_name) AS fields
 FROM orders JOIN fields ON document_id = o_orderkey GROUP BY 1""")
def doc_fields_nested(spark, d):
    docs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    rows = eav.nested(docs, t.fields(spark, d))
    flat = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("id", F.array_join(flat, ";").alias("fields"))


@query("fields_upsert", f"""{with_(FIELDS)}, n AS (SELECT document_id, 'status' AS field_name, 'X' AS field_value FROM fields WHERE field_name = 'amount' AND document_id % 7 = 0)
 SELECT document_id, field_name, field_value, confidence, source FROM fields f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.document_id = f.document_id AND n.field_name = f.field_name)
 UNION ALL SELECT document_id, field_name, field_value, 1.0, 'USER' FROM n""")
def fields_upsert(spark, d):
    rows = t.fields(spark, d)
    new = rows.filter("field_name = 'amount' AND document_id % 7 = 0").select("document_id", F.lit("status").alias("field_name"), F.lit("X").alias("field_value"))
    return eav.upsert_fields(rows, new)


FILES = """files AS (SELECT l_orderkey AS business_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS document_id,
 CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'contract' WHEN l_returnflag = 'R' THEN 'settlement' WHEN l_linenumber % 3 = 0 THEN 'cargo_right' ELSE 'invoice' END AS file_role, l_partkey, l_shipdate FROM lineitem)"""


def files_of(spark, d):
    role = F.when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "contract").when(F.col("l_returnflag") == "R", "settlement").when(F.col("l_linenumber") % 3 == 0, "cargo_right").otherwise("invoice")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("business_id"), key.alias("document_id"), role.alias("file_role"), "l_partkey", F.col("l_shipdate").alias("created_at"))


@query("first_link", f"""{with_(FILES)} SELECT l_partkey AS document_id, arg_min(business_id, (l_shipdate, business_id)) AS business_id FROM files GROUP BY 1""")
def first_link(spark, d):
    return dossier.first_link(files_of(spark, d).select(F.col("l_partkey").alias("document_id"), "business_id", "created_at"))


@query("completeness", f"""{with_(FILES)}, e AS (SELECT unnest(['contract', 'settlement', 'invoice', 'cargo_right']) AS role),
 h AS (SELECT business_id, list_distinct(list(file_role)) AS have FROM files GROUP BY 1)
 SELECT business_id, coalesce((SELECT string_agg(role, ',' ORDER BY role) FROM e WHERE list_contains(have, role)), '') AS present,
 coalesce((SELECT string_agg(role, ',' ORDER BY role) FROM e WHERE NOT list_contains(have, role)), '') AS missing, CAST(len(have) * 25 AS INTEGER) AS percent FROM h""")
def completeness(spark, d):
    return dossier.completeness(files_of(spark, d))


@query("dossier_list", f"""{with_(FILES)}, f AS (SELECT business_id, count(*) AS n_files, string_agg(DISTINCT file_role, ',' ORDER BY file_role) AS roles FROM files GROUP BY 1)
 SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS business_no, coalesce(n_files, 0) AS n_files, coalesce(roles, '') AS roles
 FROM orders LEFT JOIN f ON business_id = o_orderkey WHERE o_orderstatus = 'O' AND CAST(o_orderkey AS VARCHAR) ILIKE '%7%'""")
def dossier_list(spark, d):
    records = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("business_no"), F.col("o_orderstatus").alias("status"))
    return dossier.dossier_list(records, files_of(spark, d), status="O", keyword="7").select("id", "business_no", "n_files", "roles")


@query("category_tree", """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS path, 0 AS depth FROM region
 UNION ALL SELECT n_nationkey + 100, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def category_tree(spark, d):
    return eav.tree(t.categories(spark, d))


@query("external_by_business", f"""{with_(DETAILS)} SELECT business_no, coalesce(sum(amount) FILTER (kind = 'receipt'), 0) AS receipt_total,
 coalesce(sum(amount) FILTER (kind = 'payment'), 0) AS payment_total, count(*) AS n, max(occurred_on) AS last_on FROM details GROUP BY 1""")
def external_by_business(spark, d):
    return ledger.detail_totals(t.details(spark, d), "business_no")


@query("external_by_batch", f"""{with_(DETAILS)} SELECT batch_no, coalesce(sum(amount) FILTER (kind = 'receipt'), 0) AS receipt_total,
 coalesce(sum(amount) FILTER (kind = 'payment'), 0) AS payment_total, count(*) AS n, max(occurred_on) AS last_on FROM details GROUP BY 1""")
def external_by_batch(spark, d):
    return ledger.detail_totals(t.details(spark, d), "batch_no")


@query("external_page_total", f"""{with_(DETAILS)}, p AS (SELECT * FROM details WHERE batch_no = '1995-03' ORDER BY occurred_on DESC NULLS LAST, id DESC LIMIT 500)
 SELECT kind, count(*) AS n, sum(amount) AS amount FROM p GROUP BY 1""")
def external_page_total(spark, d):
    page = ledger.detail_page(t.details(spark, d), batch_no="1995-03")
    return page.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("batch_deleted", f"{with_(DETAILS)} SELECT batch_no, count(*) AS n FROM details WHERE batch_no IS DISTINCT FROM '1995-03' GROUP BY 1")
def batch_deleted(spark, d):
    return lifecycle.without_batch(t.details(spark, d), "batch_no", "1995-03").groupBy("batch_no").agg(F.count("*").alias("n"))


STATUS = """st AS (SELECT business_no, CASE WHEN EXISTS (SELECT 1 FROM lines x WHERE x.business_no = l.business_no) THEN CASE WHEN pay_amount IS NULL THEN 'warning' ELSE 'ok' END ELSE 'no_data' END AS status FROM ledger l)"""
SUMS = """coalesce(sum(up_settlement), 0) AS up_settlement, coalesce(sum(down_settlement), 0) AS down_settlement, coalesce(sum(pay_amount), 0) AS pay_amount,
 coalesce(sum(receipt_amount), 0) AS receipt_amount, coalesce(sum(interest_receivable), 0) AS interest_receivable, coalesce(sum(interest_received), 0) AS interest_received,
 count(*) AS n_lines, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'no_data') AS n_no_data"""


def plain_status(lines, docs):
    have = docs.select("business_no").distinct().withColumn("_have", F.lit(True))
    status = F.when(F.col("_have").isNull(), "no_data").when(F.col("pay_amount").isNull(), "warning").otherwise("ok")
    return lines.join(have, "business_no", "left").select("business_no", status.alias("status"))


@query("summary_customer", f"{with_(LEDGER, LINES, STATUS)} SELECT customer, {SUMS} FROM ledger JOIN st USING (business_no) GROUP BY 1")
def summary_customer(spark, d):
    lines = t.ledger(spark, d)
    return recon.summary(lines, plain_status(lines, t.line_documents(spark, d)), ["customer"])


@query("summary_month", f"{with_(LEDGER, LINES, STATUS)} SELECT period, {SUMS} FROM ledger JOIN st USING (business_no) GROUP BY 1")
def summary_month(spark, d):
    lines = t.ledger(spark, d)
    return recon.summary(lines, plain_status(lines, t.line_documents(spark, d)), ["period"])


@query("summary_rollup", f"{with_(LEDGER, LINES, STATUS)} SELECT segment, period, {SUMS} FROM ledger JOIN st USING (business_no) GROUP BY GROUPING SETS ((segment), (period))")
def summary_rollup(spark, d):
    lines = t.ledger(spark, d)
    return recon.summary(lines, plain_status(lines, t.line_documents(spark, d)), ["segment", "period"])


@query("backfill_stats", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'linked' WHEN o_orderstatus = 'O' THEN 'already' ELSE 'skipped' END AS outcome, count(*) AS n FROM orders GROUP BY 1""")
def backfill_stats(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "linked").when(F.col("o_orderstatus") == "O", "already").otherwise("skipped")
    return dossier.backfill_stats(t.table(spark, d, "orders").select(outcome.alias("outcome")))


@query("job_counters", f"""{with_(OPS)} SELECT job_id, count(*) AS total, count(*) FILTER (result = 'ok') AS success, count(*) FILTER (result = 'failed') AS failed,
 min(created_at) AS started_at, max(created_at) AS finished_at FROM ops GROUP BY 1""")
def job_counters(spark, d):
    return dashboard.job_counters(t.operations(spark, d))


@query("top_companies", f"{with_(FIELDS)} SELECT field_value AS company, count(*) AS n FROM fields WHERE field_name IN ('category', 'date') AND field_value <> '' GROUP BY 1 ORDER BY n DESC, company LIMIT 200")
def top_companies(spark, d):
    return dossier.top_companies(t.fields(spark, d), ["category", "date"])


@query("undo_latest", f"""{with_(OPS)} SELECT document_id, id, operation_type FROM (SELECT *, job_id AS document_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS n
 FROM ops WHERE operation_type IN ('click', 'view') AND result = 'ok') WHERE n = 1""")
def undo_latest(spark, d):
    return lifecycle.last_reversible(t.operations(spark, d).withColumn("document_id", F.col("job_id")), ["click", "view"]).select("document_id", "id", "operation_type")


@query("recycled", f"""{with_(DOCS)} SELECT CASE WHEN id % 5 = 0 THEN 'recycled' ELSE status END AS status, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM docs GROUP BY 1""")
def recycled(spark, d):
    docs = t.documents(spark, d)
    now, _ = lifecycle.recycle(docs, docs.filter("id % 5 = 0").select("id"), "by hand", F.lit("2026-01-01").cast("timestamp"))
    return now.groupBy("status").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query("batch_status", f"""{with_(DOCS)}, a AS (SELECT DISTINCT o_orderkey * 3 AS id FROM orders)
 SELECT a.id, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'need_review' THEN 'ok' ELSE 'wrong_status' END AS result FROM a LEFT JOIN docs ON docs.id = a.id""")
def batch_status(spark, d):
    return lifecycle.set_status(t.documents(spark, d), t.table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("id")), "archived", ["need_review"])[1]


@query("unique_names", f"""{with_(DOCS)}, n AS (SELECT id, document_type AS directory, source || '.txt' AS name, row_number() OVER (PARTITION BY document_type, source ORDER BY id) - 1 AS k FROM docs)
 SELECT id, directory, CASE WHEN k > 0 THEN regexp_extract(name, '^(.*?)\\.txt$', 1) || '_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || '.txt' ELSE name END AS filename FROM n""")
def unique_names(spark, d):
    return lifecycle.unique_names(t.documents(spark, d), F.col("document_type"), F.concat("source", F.lit(".txt")))
