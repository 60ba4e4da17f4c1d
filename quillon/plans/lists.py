"""Queries of lists, worklists, names, templates and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cell_text, lookup_key
from ..operators import cluster, dashboard, library, lifecycle, recon, reports
from ..sources import tables as t
from ..sources.shared import new_path, written
from .catalogue import DETAILS, DOCS, FIELDS, LEDGER, LINES, OPS, query, with_

STATUS = "CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'no_data' ELSE 'warning' END"


def reports_of(spark, d):
    """A report for each order, with a status by its key."""
    k = F.col("o_orderkey") % 4
    status = F.when(k == 0, "ok").when(k == 1, "error").when(k == 2, "no_data").otherwise("warning")
    return t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("business_no"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer"), "o_orderpriority", status.alias("status"))


@query("category_filter", f"{with_(FIELDS)} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT document_id FROM fields WHERE field_name = 'category' AND field_value = '1-URGENT')")
def category_filter(spark, d):
    docs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return library.in_category(docs, t.fields(spark, d), ["category", "suggested_category"], "1-URGENT")


@query("report_page", f"""SELECT id, status FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS business_no, 'C' || o_custkey AS customer, {STATUS} AS status FROM orders)
 WHERE business_no ILIKE '%7%' OR customer ILIKE '%c1%' ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END, id DESC LIMIT 150 OFFSET 100""")
def report_page(spark, d):
    rows = reports_of(spark, d).withColumn("seven", F.when(F.contains("business_no", F.lit("7")), "c1"))
    return reports.page(rows, keyword="c1", columns=("customer", "seven"), limit=150, offset=100).select("id", "status")


@query("summary_ranked", f"""{with_(LEDGER, LINES)}, s AS (SELECT segment, count(*) FILTER (n IS NULL) AS n_error, count(*) FILTER (n = 1) AS n_warning FROM ledger LEFT JOIN (SELECT business_no, count(*) AS n FROM lines GROUP BY 1) USING (business_no) GROUP BY 1)
 SELECT segment, n_error, n_warning FROM s ORDER BY n_error * 10 + n_warning DESC, segment LIMIT 3""")
def summary_ranked(spark, d):
    """Lines without documents count as errors, lines with one as warnings; the three worst segments."""
    n = t.line_documents(spark, d).groupBy("business_no").agg(F.count("*").alias("n"))
    lines = t.ledger(spark, d)
    status = lines.select("business_no").join(n, "business_no", "left").select("business_no", F.when(F.col("n").isNull(), "error").when(F.col("n") == 1, "warning").otherwise("ok").alias("status"))
    return reports.worst_first(recon.summary(lines, status, ["segment"]), "segment").limit(3).select("segment", "n_error", "n_warning")


@query("urge_append", f"SELECT CAST(o_orderkey AS VARCHAR) AS business_no, CASE WHEN o_orderkey % 6 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_urges, CASE WHEN o_orderkey % 6 = 0 THEN 'again' WHEN o_orderkey % 2 = 0 THEN 'please' END AS last_note FROM orders")
def urge_append(spark, d):
    rows = reports_of(spark, d).withColumn("urges", F.lit(None).cast("array<struct<at: timestamp, note: string>>"))
    once = reports.urged(rows, rows.filter("id % 2 = 0"), F.lit("please"), F.lit("2026-01-01"))
    twice = reports.urged(once, rows.filter("id % 6 = 0"), F.lit("again"), F.lit("2026-01-02"))
    n = F.when(F.col("urges").isNull(), 0).otherwise(F.size("urges"))
    return twice.select("business_no", n.alias("n_urges"), F.when(n > 0, F.element_at("urges", -1)["note"]).alias("last_note"))


@query("report_external", f"""{with_(DETAILS)}, e AS (SELECT business_no, sum(amount) FILTER (kind = 'receipt') AS receipts, sum(amount) FILTER (kind = 'payment') AS payments, count(*) AS n FROM details GROUP BY 1)
 SELECT r.business_no, coalesce(receipts, 0) AS receipts, coalesce(payments, 0) AS payments, coalesce(n, 0) AS n FROM (SELECT CAST(o_orderkey AS VARCHAR) AS business_no FROM orders) r LEFT JOIN e ON e.business_no = r.business_no""")
def report_external(spark, d):
    details = t.details(spark, d)
    own = details.groupBy("business_no").agg(F.sum(F.when(F.col("kind") == "receipt", F.col("amount"))).alias("receipts"), F.sum(F.when(F.col("kind") == "payment", F.col("amount"))).alias("payments"), F.count("*").alias("n"))
    return reports.with_external(reports_of(spark, d).select("business_no"), own)


LABELS = {"error": "异常", "warning": "预警", "ok": "正常"}


@query("status_labels", f"SELECT o_orderkey AS id, CASE {STATUS} WHEN 'error' THEN '异常' WHEN 'warning' THEN '预警' WHEN 'ok' THEN '正常' ELSE {STATUS} END AS label FROM orders")
def status_labels(spark, d):
    return reports_of(spark, d).select("id", reports.labelled(F.col("status"), LABELS).alias("label"))


@query("open_records", f"{with_(DOCS)} SELECT source || '/' || document_type AS path, max(id) AS id FROM docs WHERE status IN ('pending', 'need_review') GROUP BY 1")
def open_records(spark, d):
    docs = t.documents(spark, d).withColumn("path", F.concat_ws("/", "source", "document_type"))
    return library.open_records(docs, "path", ["pending", "need_review"])


@query("work_list", f"{with_(DOCS)} SELECT id FROM docs WHERE status = 'pending' OR id % 3 = 0")
def work_list(spark, d):
    docs = t.documents(spark, d).select("id", "status")
    return library.worklist([docs.filter("status = 'pending'"), docs.filter("id % 3 = 0")]).select("id")


@query("dossier_candidates", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT l_partkey % 100 FROM lineitem WHERE l_orderkey = 1)")
def dossier_candidates(spark, d):
    links = t.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("business_no"), (F.col("l_partkey") % 100).alias("document_id"))
    return library.candidates(t.table(spark, d, "documents").select(F.col("doc_id").alias("id")), links, "1")


@query("retry_failed", f"""{with_(OPS)}, j AS (SELECT id, CASE WHEN result = 'failed' THEN 'failed' WHEN operation_type = 'view' THEN 'done' ELSE 'running' END AS status, id % 3 AS attempts FROM ops)
 SELECT id, CASE WHEN id % 10 = 0 AND status <> 'done' THEN 'cancelled' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND id % 10 > 0 THEN attempts + 1 ELSE attempts END AS attempts FROM j""")
def retry_failed(spark, d):
    ops = t.operations(spark, d)
    status = F.when(F.col("result") == "failed", "failed").when(F.col("operation_type") == "view", "done").otherwise("running")
    return library.retried(ops.select("id", status.alias("status"), (F.col("id") % 3).alias("attempts")), ops.filter("id % 10 = 0").select("id"))


def bin_of(spark, d):
    return t.documents(spark, d).filter("id % 5 = 0").select("id", "file_size", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("deleted_at"))


@query("recycle_page", f"{with_(DOCS)} SELECT id FROM docs WHERE id % 5 = 0 ORDER BY id % 7 DESC, id DESC LIMIT 50 OFFSET 5")
def recycle_page(spark, d):
    return library.bin_page(bin_of(spark, d), 50, 5).select("id")


@query("recycle_size", f"{with_(DOCS)} SELECT count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM docs WHERE id % 5 = 0")
def recycle_size(spark, d):
    return library.bin_size(bin_of(spark, d))


@query("cluster_sizes", f"{with_(DOCS)} SELECT 'type:' || document_type AS group_key, count(*) AS n, min(id) AS first_seen FROM docs GROUP BY 1 HAVING count(*) > 1")
def cluster_sizes(spark, d):
    none = F.lit("")
    groups = cluster.cascading_groups(t.documents(spark, d), "id", none, F.col("document_type"), none, none)
    return library.by_size(groups, "group_key", "id")


@query("previews", f"""{with_(DOCS)} SELECT document_type, string_agg(original_filename, '|' ORDER BY id) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY id) AS r FROM docs) WHERE r <= 6 GROUP BY 1""")
def previews(spark, d):
    return library.previews(t.documents(spark, d), "document_type", "original_filename", "id").withColumn("preview", F.array_join("preview", "|"))


def nations(spark, d):
    return t.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("sort_order"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))


@query("config_list", "SELECT n_name AS name, n_nationkey AS sort_order FROM nation WHERE n_nationkey % 2 = 0")
def config_list(spark, d):
    return library.listed(nations(spark, d), [F.col("sort_order")]).select("name", "sort_order")


TEMPLATES = {"en": "{id}_{source}", "fr": "{source|upper}"}


@query("template_lookup", f"{with_(DOCS)} SELECT id, CASE document_type WHEN 'en' THEN '{{id}}_{{source}}' WHEN 'fr' THEN '{{source|upper}}' ELSE '{{id}}' END AS template FROM docs")
def template_lookup(spark, d):
    templates = spark.createDataFrame(list(TEMPLATES.items()), "category string, template string")
    return library.with_template(t.documents(spark, d), templates, "document_type", "{id}").select("id", "template")


@query("suggested_names", f"{with_(DOCS)} SELECT id, CASE document_type WHEN 'en' THEN id || '_' || source WHEN 'fr' THEN upper(source) ELSE CAST(id AS VARCHAR) END || '.txt' AS suggested_name FROM docs")
def suggested_names(spark, d):
    docs = t.documents(spark, d)
    return library.suggested_names(docs, TEMPLATES, F.col("document_type"), "{id}", {c: F.col(c) for c in docs.columns}, F.lit(".txt")).select("id", "suggested_name")


@query("candidate_types", """WITH n AS (SELECT string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN n_name END AS best, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT c_custkey, CASE WHEN best IS NOT NULL AND n_nationkey % 2 = 1 THEN best || '|' || names ELSE names END AS types FROM c, n""")
def candidate_types(spark, d):
    names = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("category"))
    best = t.table(spark, d, "customer").join(F.broadcast(names), "c_nationkey").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("category")).alias("category"))
    return library.candidate_types(best, nations(spark, d), "c_custkey").withColumn("types", F.array_join("types", "|"))


@query("mean_confidence", "SELECT l_orderkey AS document_id, round(avg(l_discount), 8) AS confidence FROM lineitem GROUP BY 1")
def mean_confidence(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_discount").alias("confidence"))
    return library.mean_confidence(rows).withColumn("confidence", F.round("confidence", 8))


@query("config_levels", "SELECT o_orderpriority AS area, o_orderstatus AS part, CASE max(o_custkey % 11 // 5) WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'error' END AS level FROM orders GROUP BY 1, 2")
def config_levels(spark, d):
    k = F.floor((F.col("o_custkey") % 11) / 5)
    rows = t.table(spark, d, "orders").select(F.col("o_orderpriority").alias("area"), F.col("o_orderstatus").alias("part"), F.when(k == 0, "ok").when(k == 1, "warning").otherwise("error").alias("level"))
    return library.worst_level(rows, ["area", "part"])


@query("cell_text", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity,
 strftime(l_shipdate, '%Y-%m-%d') AS day, trim(' ' || l_returnflag || ' ') AS flag FROM lineitem""")
def cell_texts(spark, d):
    rows = t.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cell_text(F.col("l_quantity"), "double").alias("quantity"), cell_text(F.col("l_shipdate"), "date").alias("day"), cell_text(F.concat(F.lit(" "), "l_returnflag", F.lit(" ")), "string").alias("flag"))


@query("patched_documents", f"{with_(DOCS)} SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN id % 8 = 0 THEN 'new-' || id ELSE original_filename END AS original_filename FROM docs")
def patched_documents(spark, d):
    docs = t.documents(spark, d).select("id", "status", "original_filename")
    changes = docs.filter("id % 4 = 0").select("id", F.lit("archived").alias("status"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("new-"), F.col("id").cast("string"))).alias("original_filename"))
    return library.patched(docs, changes)


@query("lookup_override", """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS contract, o_orderkey % 3 = 0 AS sale, o_orderkey % 5 > 0 AS hit FROM orders)
 SELECT id, CASE WHEN hit AND contract THEN CASE WHEN sale THEN 's' ELSE 'l' END ELSE 'd' END AS amount, CASE WHEN hit THEN 'l' ELSE 'd' END AS vessel, CASE WHEN hit THEN 'l' END AS material FROM x""")
def lookup_override(spark, d):
    """Documents with amount and vessel of their own; the ledger knows four fifths of them, with a sale's amount for a third."""
    docs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("amount"), F.lit("d"), F.lit("vessel"), F.lit("d"), F.lit("empty"), F.lit("")).alias("values"))
    hit = docs.filter("id % 5 > 0").select("id", F.create_map(F.lit("amount"), F.lit("l"), F.lit("vessel"), F.lit("l"), F.lit("material"), F.lit("l"), F.lit("date"), F.lit(" ")).alias("values"), F.create_map(F.lit("amount"), F.lit("s")).alias("sale_values"), (F.col("id") % 3 == 0).alias("is_sale"))
    out = library.overridden(docs, hit, "id", F.col("id") % 2 == 0)
    return out.select("id", *[F.try_element_at("values", F.lit(k)).alias(k) for k in ("amount", "vessel", "material")])


@query("relocated_files", f"""{with_(DOCS)} SELECT id, CASE WHEN id % 3 = 0 THEN '/a/' || original_filename WHEN id % 3 = 1 THEN '/b/' || original_filename END AS found_path FROM docs""")
def relocated_files(spark, d):
    """Files by their current name, by their original name, or of the same name with another content."""
    docs = t.documents(spark, d)
    k = F.col("id") % 3
    missing = docs.select("id", "file_hash", "original_filename", F.when(k == 0, F.col("original_filename")).otherwise("moved").alias("current_filename"))
    folder = F.when(k == 0, "/a/").when(k == 1, "/b/").otherwise("/c/")
    files = docs.select(F.col("original_filename").alias("name"), F.concat(folder, "original_filename").alias("path"), F.when(k == 0, F.col("file_hash")).when(k == 2, "other").alias("file_hash"))
    return library.relocated(missing, files)


@query("compatible_keys", """SELECT o_orderkey AS id, upper(CASE o_orderkey % 5 WHEN 0 THEN 'AB-' WHEN 1 THEN '12' WHEN 2 THEN 'm2' WHEN 3 THEN 'fi' ELSE '(1)' END || o_orderkey) AS key FROM orders""")
def compatible_keys(spark, d):
    """Full-width letters, circled digits, units and ligatures before a number."""
    forms = F.element_at(F.array(*map(F.lit, ["Ａｂ－", "①②", "㎡", "ﬁ", "⑴"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), lookup_key(F.concat(forms, F.lit("　"), F.col("o_orderkey").cast("string"))).alias("key"))


@query("observed_counters", f"""{with_(OPS)} SELECT count(*) AS total, count(*) FILTER (result = 'ok') AS success, count(*) FILTER (result = 'failed') AS failed, count(DISTINCT job_id) AS jobs, min(created_at) AS started_at, max(created_at) AS finished_at FROM ops""")
def observed_counters(spark, d):
    """AGG-27, STR-05: counters of all operations, observed by the job that writes the counters of each job."""
    result, at = F.col("result"), F.col("created_at")
    ops = t.operations(spark, d)
    kept: list = []
    counts = lifecycle.counted(
        ops, lambda rows: kept.append(written(dashboard.job_counters(rows), "job-counters")),
        total=F.count("*"), success=F.count_if(result == "ok"), failed=F.count_if(result == "failed"), started_at=F.min(at), finished_at=F.max(at),
    )
    jobs = kept[0].agg(F.count("*").alias("jobs"))
    return jobs.select(*[F.lit(v).alias(k) for k, v in counts.items()], "jobs")


@query("backup_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def backup_counts(spark, d):
    """SNK-06, AGG-38."""
    tables = {name: t.table(spark, d, name) for name in ("orders", "events")}
    folder = new_path(spark, "backup")
    counts = lifecycle.backup(tables, folder)
    back = lifecycle.restored(spark, folder, list(tables))
    out = None
    for name, df in back.items():  # the restored rows must be as many as were counted
        one = df.agg(F.count("*").alias("n")).filter(F.col("n") == counts[name]).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out
