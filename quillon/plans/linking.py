"""Queries of linking and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import diff_key
from ..operators import joins, ledger, lifecycle, recon, reports
from ..sources import tables as t
from ..sources.shared import scratch, written
from .catalogue import LEDGER, LINES, query, with_

UNIQ = """u AS (SELECT *, CASE WHEN amount IS NOT NULL AND doc_date IS NOT NULL THEN first_value(document_id) OVER (PARTITION BY business_no, direction, role, amount, doc_date ORDER BY document_id) ELSE document_id END AS kept FROM lines)"""
CELLS = """cells AS (SELECT business_no, direction, role, count(*) AS n, string_agg(document_id, ',' ORDER BY document_id) AS ids, sum(amount) FILTER (kept = document_id) AS amount,
 sum(amount) FILTER (kept = document_id AND nature = 'payment') AS goods, count(*) FILTER (nature <> 'payment') AS n_extra,
 string_agg(document_id, ',' ORDER BY document_id) FILTER (nature <> 'payment') AS extra_ids FROM u GROUP BY 1, 2, 3)"""
ALL = [LEDGER, LINES, UNIQ, CELLS]


def flat(diffs):
    return diffs.withColumn("document_ids", F.array_join("document_ids", ","))


def both(spark, d):
    return t.ledger(spark, d), t.line_documents(spark, d)


DIFF_COLS = "business_no, rule, type, severity, direction, role, expected, actual, delta, document_ids"


def d_(rule, kind, severity, direction, role, expected="''", actual="''", delta="''", ids="''"):
    return f"business_no, '{rule}' AS rule, '{kind}' AS type, {severity} AS severity, {direction} AS direction, {role} AS role, {expected} AS expected, {actual} AS actual, {delta} AS delta, {ids} AS document_ids"


M = "CAST({} AS VARCHAR)".format
R1 = f"""chk AS (SELECT l.*, c.direction, c.role FROM ledger l, (VALUES ('up','settlement'),('up','invoice'),('up','payment_receipt'),('down','settlement'),('down','invoice')) c(direction, role)),
 full_ AS (SELECT chk.*, n, ids, amount, n_extra, extra_ids, CASE WHEN chk.role = 'payment_receipt' THEN 'WARNING' WHEN (chk.direction = 'up' AND (up_settlement > 0.01 OR pay_amount > 0.01)) OR (chk.direction = 'down' AND (down_settlement > 0.01 OR receipt_amount > 0.01)) THEN 'CRITICAL' ELSE 'WARNING' END AS sev
  FROM chk LEFT JOIN cells USING (business_no, direction, role)),
 r1 AS (SELECT {d_('R1', 'amount_mismatch', "'INFO'", 'direction', 'role', "'goods only'", M('n_extra'), ids='extra_ids')} FROM full_ WHERE n_extra > 0
  UNION ALL SELECT {d_('R1', 'unparsed_amount', "'WARNING'", 'direction', 'role', ids='ids')} FROM full_ WHERE n > 0 AND amount IS NULL
  UNION ALL SELECT {d_('R1', 'missing_doc', 'sev', 'direction', 'role', "'>=1'", "'0'")} FROM full_ WHERE n IS NULL)"""


def amount_sql(rule, direction, role, expected, under):
    return f"""SELECT {d_(rule, 'amount_mismatch', f"CASE WHEN amount < {expected} THEN '{under}' ELSE 'CRITICAL' END", f"'{direction}'", f"'{role}'", M(expected), M('amount'), M(f'amount - {expected}'), 'ids')}
 FROM ledger JOIN cells c USING (business_no) WHERE c.direction = '{direction}' AND c.role = '{role}' AND abs(amount - {expected}) > 0.01"""


R2 = f"""rc AS (SELECT business_no, pay_amount, ids, goods, coalesce(goods, CAST(0 AS DECIMAL(18,2))) AS covered FROM ledger LEFT JOIN (SELECT * FROM cells WHERE direction = 'up' AND role = 'payment_receipt') USING (business_no)),
 r2 AS ({amount_sql('R2', 'up', 'settlement', 'up_settlement', 'CRITICAL')} UNION ALL {amount_sql('R2', 'up', 'invoice', 'up_settlement', 'WARNING')}
 UNION ALL SELECT {d_('R2', 'amount_mismatch', "'INFO'", "'up'", "'payment_receipt'", M('up_settlement'), M('pay_amount'), M('pay_amount - up_settlement'))} FROM ledger WHERE abs(pay_amount - up_settlement) > 0.01
 UNION ALL SELECT {d_('R2', 'amount_mismatch', "CASE WHEN goods IS NULL THEN 'INFO' WHEN covered > pay_amount THEN 'CRITICAL' ELSE 'WARNING' END", "'up'", "'payment_receipt'", M('pay_amount'), M('CAST(covered AS DECIMAL(18,2))'), M('CAST(covered - pay_amount AS DECIMAL(18,2))'), "coalesce(ids, '')")} FROM rc WHERE abs(covered - pay_amount) > 0.01)"""
R3 = f"r3 AS ({amount_sql('R3', 'down', 'settlement', 'down_settlement', 'CRITICAL')} UNION ALL {amount_sql('R3', 'down', 'invoice', 'down_settlement', 'WARNING')})"
GAP = "(down_settlement - up_settlement)"
R4 = f"""i AS (SELECT *, CAST({GAP} AS DECIMAL(18,2)) AS gap, coalesce(abs({GAP} - interest_receivable) <= 0.01, false) OR coalesce(abs({GAP} - interest_received) <= 0.01, false) AS fits, coalesce(interest_receivable, interest_received) AS ref FROM ledger WHERE {GAP} IS NOT NULL),
 r4 AS (SELECT {d_('R4', 'interest_mismatch', "'INFO'", "'cross'", "'interest'", M('interest_receivable'), M('interest_received'), M('interest_received - interest_receivable'))} FROM i WHERE fits AND abs(interest_received - interest_receivable) > 0.01
 UNION ALL SELECT {d_('R4', 'interest_mismatch', "'CRITICAL'", "'cross'", "'interest'", M('gap'), M('ref'), M('ref - gap'))} FROM i WHERE NOT fits AND ref IS NOT NULL
 UNION ALL SELECT {d_('R4', 'interest_mismatch', "'WARNING'", "'cross'", "'interest'", M('up_settlement'), M('down_settlement'), M('gap'))} FROM i WHERE ref IS NULL AND abs(gap) > 0.01)"""
R6 = f"""r6 AS (SELECT {d_('R6', 'date_conflict', "'WARNING'", 'direction', 'role', M('up_contract_date'), M('doc_date'), ids='document_id')} FROM lines JOIN ledger USING (business_no) WHERE doc_date < up_contract_date)"""
R7 = f"""f7 AS (SELECT *, first_value(document_id) OVER (PARTITION BY business_no, invoice_no ORDER BY document_id) AS first_id FROM lines WHERE role = 'invoice'),
 r7 AS (SELECT {d_('R7', 'duplicate_biz', "'WARNING'", 'direction', "'invoice'", actual='invoice_no', ids="first_id || ',' || document_id")} FROM f7 WHERE first_id <> document_id)"""
DUP = f"""dup AS (SELECT {d_('DUP', 'amount_mismatch', "'INFO'", 'direction', 'role', ids="kept || ',' || document_id")} FROM u WHERE kept <> document_id)"""
EVERY = [*ALL, DUP, R1, R2, R3, R4, R6, R7]
DIFFS = """every_ AS (SELECT * FROM (SELECT * FROM dup UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r6 UNION ALL SELECT * FROM r7)
 WHERE business_no IN (SELECT business_no FROM lines))"""
KEY = "substr(sha1(concat_ws('|', type, direction, role, expected, actual, document_ids)), 1, 12)"
STATUSES = """status_ AS (SELECT l.business_no, coalesce(n_docs, 0) AS n_docs, coalesce(n_diffs, 0) AS n_diffs,
 CASE WHEN n_docs IS NULL THEN 'no_data' WHEN worst = 2 THEN 'error' WHEN worst = 1 THEN 'warning' ELSE 'ok' END AS status FROM ledger l
 LEFT JOIN (SELECT business_no, count(*) AS n_docs FROM lines GROUP BY 1) USING (business_no)
 LEFT JOIN (SELECT business_no, count(*) AS n_diffs, max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS worst FROM every_ GROUP BY 1) USING (business_no))"""


@query("matrix", f"""{with_(*ALL)}, g AS (SELECT business_no, direction, role FROM ledger, (VALUES ('up'), ('down')) a(direction), (VALUES ('contract'), ('settlement'), ('invoice'), ('cargo_right'), ('payment_receipt')) b(role)),
 w AS (SELECT business_no, role, count(*) AS candidates FROM lines WHERE nature = 'deposit' GROUP BY 1, 2)
 SELECT business_no, direction, role, coalesce(n, 0) AS n, coalesce(CASE WHEN role = 'payment_receipt' THEN goods ELSE amount END, 0) AS amount, coalesce(candidates, 0) AS candidates FROM g LEFT JOIN cells USING (business_no, direction, role) LEFT JOIN w USING (business_no, role)""")
def matrix(spark, d):
    lines, docs = both(spark, d)
    return recon.matrix(lines, docs, docs.filter("nature = 'deposit'"))


@query("cell_dedup", f"""{with_(LINES)}, r AS (SELECT document_id, business_no, direction, role, CAST(floor(amount / 20000) * 20000 AS DECIMAL(18,2)) AS amount, CAST(date_trunc('year', doc_date) AS DATE) AS doc_date FROM lines),
 k AS (SELECT *, first_value(document_id) OVER (PARTITION BY business_no, direction, role, amount, doc_date ORDER BY document_id) AS kept FROM r WHERE amount IS NOT NULL AND doc_date IS NOT NULL) SELECT document_id, kept AS kept_id FROM k WHERE kept <> document_id""")
def cell_dedup(spark, d):
    """Amounts in steps and days in years, so that documents of a cell repeat."""
    docs = t.line_documents(spark, d).withColumns({"amount": (F.floor(F.col("amount") / 20000) * 20000).cast("decimal(18,2)"), "doc_date": F.to_date(F.date_trunc("year", "doc_date"))})
    return recon.unique_in_cell(docs).filter("kept_id <> document_id").select("document_id", "kept_id")


@query("r1_missing", f"{with_(*ALL, R1)} SELECT * FROM r1")
def r1_missing(spark, d):
    return flat(recon.r1_completeness(*both(spark, d)))


@query("r2_upstream", f"{with_(*ALL, R2)} SELECT * FROM r2")
def r2_upstream(spark, d):
    return flat(recon.r2_upstream(*both(spark, d)))


@query("r3_downstream", f"{with_(*ALL, R3)} SELECT * FROM r3")
def r3_downstream(spark, d):
    return flat(recon.r3_downstream(*both(spark, d)))


@query("r4_interest", f"{with_(LEDGER, R4)} SELECT * FROM r4")
def r4_interest(spark, d):
    return flat(recon.r4_interest(t.ledger(spark, d)))


@query("r5_membership", f"""{with_(LEDGER, LINES)} SELECT {d_('R5', 'chain_break', "CASE WHEN CAST(business_no AS BIGINT) % 2 = 0 THEN 'INFO' ELSE 'WARNING' END", 'direction', 'role', actual="CASE WHEN direction = 'up' THEN 'cg' ELSE 'xs' END || '（DD） -' || business_no", ids='document_id')} FROM lines JOIN ledger USING (business_no) WHERE direction = 'down'""")
def r5_membership(spark, d):
    """Only the upstream number counts here, so each downstream document breaks the chain; those of every other line have its amount."""
    lines, docs = both(spark, d)
    even = F.col("business_no").cast("long") % 2 == 0
    own = docs.join(lines.select("business_no", "up_settlement"), "business_no").withColumn("amount", F.when(even, F.col("up_settlement")))
    return flat(recon.r5_membership(lines, own.drop("up_settlement"), ["up_contract_no"]))


@query("r6_dates", f"{with_(LEDGER, LINES, R6)} SELECT * FROM r6")
def r6_dates(spark, d):
    return flat(recon.r6_dates(*both(spark, d)))


@query("r7_invoice_dup", f"{with_(LINES, R7)} SELECT * FROM r7")
def r7_invoice_dup(spark, d):
    return flat(recon.r7_invoices(t.line_documents(spark, d)))


def found(spark, d):
    lines, docs = both(spark, d)
    return lines, docs, recon.differences(lines, docs, ["up_contract_no", "down_contract_no"])


@query("recon_diffs", f"{with_(*EVERY, DIFFS)} SELECT *, {KEY} AS key FROM every_")
def recon_diffs(spark, d):
    return flat(recon.differences(*both(spark, d), NUMBERS, lambda rule: written(rule, "diffs")))


#: Loose documents, bound by number, amount, party or cargo: names of one shape hold one another only if they are equal.
LOOSE = """anchor AS (SELECT business_no, k, d, CAST(v AS DECIMAL(18,2)) AS v FROM (
  SELECT business_no, unnest([0, 1, 2, 4, 5, 6, 7, 8]) AS k, unnest(['up', 'up', 'up', 'down', 'down', 'down', 'down', 'down']) AS d,
   unnest([up_contract_amount, up_settlement, pay_amount, down_settlement, receipt_amount, interest_received, receipt_amount + interest_received, down_settlement + interest_received]) AS v FROM ledger) WHERE v > 0),
 fresh AS (SELECT * FROM anchor a WHERE NOT EXISTS (SELECT 1 FROM anchor b WHERE b.business_no = a.business_no AND b.k < a.k AND abs(a.v - b.v) <= 0.01)),
 item AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS document_id, CAST(l_orderkey AS VARCHAR) AS own, (l_orderkey * 7 + l_linenumber) % 5 AS kind,
  CASE WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS side, CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 = 4 THEN 'cargo_right' WHEN l_returnflag = 'R' THEN 'payment_receipt' WHEN l_linenumber % 2 = 0 THEN 'invoice' ELSE 'settlement' END AS role,
  CASE WHEN l_tax >= 0.08 THEN 'deposit' ELSE 'payment' END AS nature,
  CASE (l_orderkey * 7 + l_linenumber) % 5 WHEN 0 THEN CASE WHEN l_discount < 0.095 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END WHEN 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1000 AS DECIMAL(18,2)) END AS amount,
  CAST(l_shipdate AS DATE) AS doc_date, 'INV' || l_partkey AS invoice_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 hit AS (SELECT document_id, business_no, arg_min(d, k) AS direction FROM item JOIN fresh ON amount >= v - 0.01 AND amount <= v + 0.01 WHERE kind IN (1, 2) GROUP BY 1, 2),
 one AS (SELECT document_id, min(business_no) AS business_no, min(direction) AS direction FROM hit GROUP BY 1 HAVING count(*) = 1),
 lines AS (SELECT document_id, CASE WHEN kind IN (1, 2) THEN one.business_no ELSE own END AS business_no, CASE kind WHEN 0 THEN side WHEN 3 THEN 'up' WHEN 4 THEN 'down' ELSE one.direction END AS direction,
  CASE kind WHEN 0 THEN 'number' WHEN 3 THEN 'party' WHEN 4 THEN 'cargo' ELSE 'amount' END AS basis, kind = 0 AS numbered, role, nature, amount, doc_date, invoice_no
  FROM item LEFT JOIN one USING (document_id) WHERE kind NOT IN (1, 2) OR one.business_no IS NOT NULL)"""
LOOSE_UNIQ = UNIQ.replace("CASE WHEN amount IS NOT NULL", "CASE WHEN numbered AND amount IS NOT NULL").replace("PARTITION BY business_no", "PARTITION BY numbered, business_no")
FROM_LOOSE = [LEDGER, LOOSE, LOOSE_UNIQ, CELLS, DUP, R1, R2, R3, R4, R6, R7]
NUMBERS = ["up_contract_no", "down_contract_no"]


def bound(spark, d, keep):
    """(lines, bound, pool)"""
    lines = t.named_ledger(spark, d)
    with scratch(spark) as put:  # what is bound is a table of its own
        docs = put(t.loose_documents(spark, d).drop("filename"), "loose-documents")
        return lines, *recon.bind(lines, docs, ["up_contract_no"], ["down_contract_no"], keep)


def bound_documents(spark, d, keep=()):
    lines, docs, _ = bound(spark, d, [*keep, "role", "amount", "seller", "company"])
    return lines, recon.assign(lines, docs)


def reconciled(spark, d, *read):
    """From documents that nothing binds yet to differences: binding, sides, all rules; of these the columns that are read, rule by rule."""
    lines, docs = bound_documents(spark, d, recon.RULES_READ)
    return lines, docs, recon.differences(lines, docs, NUMBERS, lambda rule: written(rule, "diffs"), ["severity", *read])


@query("bind_documents", f"{with_(LEDGER, LOOSE)} SELECT document_id, business_no, direction, basis FROM lines")
def bind_documents(spark, d):
    return bound_documents(spark, d)[1].select("document_id", "business_no", "direction", "basis")


@query("document_pool", f"{with_(LEDGER, LOOSE)} SELECT document_id FROM item WHERE document_id NOT IN (SELECT document_id FROM lines)")
def document_pool(spark, d):
    return bound(spark, d, [])[2].select("document_id")


@query("subset_sum", """WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS business_no, sum(CASE WHEN l_linenumber <= 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS pay FROM lineitem GROUP BY 1),
 g AS (SELECT CAST(l_orderkey AS VARCHAR) AS business_no, list({'id': concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber), 'amount': CAST(l_extendedprice AS DECIMAL(18,2))} ORDER BY concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS own FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
 m AS (SELECT business_no, own, unnest(range(1, CAST(pow(2, len(own)) AS BIGINT))) AS mask FROM g), s AS (SELECT business_no, mask, list_filter(own, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS own FROM m),
 h AS (SELECT business_no, arg_min(own, (-len(own), mask)) AS own FROM s JOIN a USING (business_no) WHERE pay > 0 AND abs(list_sum(list_transform(own, lambda x: x.amount)) - pay) <= 0.01 GROUP BY 1)
 SELECT business_no, unnest(own).id AS document_id, 'up' AS direction FROM h""")
def subset_sum(spark, d):
    lines, docs = t.split_payments(spark, d)
    return recon.subset_sums(docs, lines).select("business_no", "document_id", "direction")


@query("assign_sides", f"""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS business_no, CAST(o_totalprice AS DECIMAL(18,2)) AS pay FROM orders), x AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS document_id, CAST(l_orderkey AS VARCHAR) AS business_no, l_linenumber AS n FROM lineitem)
 SELECT document_id, business_no, CASE WHEN n % 3 = 0 AND pay > 0 THEN 'up' ELSE 'unknown' END AS direction FROM x JOIN p USING (business_no)""")
def assign_sides(spark, d):
    """Documents of known lines: a third has the line's payment as amount, the others none."""
    lines = t.ledger(spark, d).select("business_no", F.col("up_settlement").alias("pay_amount"))
    docs = t.line_documents(spark, d).select("document_id", "business_no", F.lit("unknown").alias("direction"), F.lit("settlement").alias("role"), F.element_at(F.split("document_id", "-"), -1).cast("int").alias("n"))
    docs = docs.join(lines, "business_no").withColumn("amount", F.when(F.col("n") % 3 == 0, F.col("pay_amount"))).drop("pay_amount")
    return recon.assign(lines, docs).select("document_id", "business_no", "direction")


@query("status_rollup", f"{with_(*FROM_LOOSE, DIFFS, STATUSES)} SELECT * FROM status_")
def status_rollup(spark, d):
    return recon.statuses(*reconciled(spark, d))


@query("recon_report", f"""{with_(*FROM_LOOSE, DIFFS, STATUSES)}, n AS (SELECT business_no, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'WARNING') AS n_warning, count(*) FILTER (severity = 'INFO') AS n_info, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM every_ GROUP BY 1)
 SELECT business_no, status, n_docs, coalesce(n_critical, 0) AS n_critical, coalesce(n_warning, 0) AS n_warning, coalesce(n_info, 0) AS n_info, coalesce(rules, '') AS rules FROM status_ LEFT JOIN n USING (business_no)""")
def recon_report(spark, d):
    lines, docs, diffs = reconciled(spark, d, "rule", "type", "direction", "role", "key")
    made = reports.encode(recon.statuses(lines, docs, diffs), diffs)
    return reports.detail(made).select("business_no", "status", "n_docs", "n_critical", "n_warning", "n_info", F.array_join("rules", ",").alias("rules"))


@query("export_diffs", f"{with_(*FROM_LOOSE, DIFFS)} SELECT business_no, rule, type, severity, document_ids, {KEY} AS key FROM every_")
def export_diffs(spark, d):
    lines, docs, diffs = reconciled(spark, d, "rule", "type", "document_ids", "key")
    sheets = lifecycle.export_tables(recon.statuses(lines, docs, diffs), diffs, docs.limit(0))
    return sheets["differences"].select("business_no", "rule", "type", "severity", "document_ids", "key")


@query("run_summary", f"{with_(*FROM_LOOSE, DIFFS, STATUSES)} SELECT status, count(*) AS n_lines, CAST(sum(n_diffs) AS BIGINT) AS n_diffs FROM status_ GROUP BY 1")
def run_summary(spark, d):
    return recon.statuses(*reconciled(spark, d)).groupBy("status").agg(F.count("*").alias("n_lines"), F.sum("n_diffs").alias("n_diffs"))


@query("urge_list", f"""{with_(*ALL, R1)} SELECT business_no, count(*) AS n_missing, string_agg(direction || '/' || role, ',' ORDER BY direction || '/' || role) AS missing FROM r1 WHERE type = 'missing_doc' GROUP BY 1""")
def urge_list(spark, d):
    return recon.urge_list(recon.r1_completeness(*both(spark, d))).withColumn("missing", F.array_join("missing", ","))


@query("export_missing", f"{with_(*EVERY, DIFFS)} SELECT business_no, direction, role, severity FROM every_ WHERE type = 'missing_doc'")
def export_missing(spark, d):
    lines, docs, diffs = found(spark, d)
    sheets = lifecycle.export_tables(recon.statuses(lines, docs, diffs), diffs, docs.limit(0))
    return sheets["missing"].select("business_no", "direction", "role", "severity")


@query("invoice_uniqueness", f"""{with_(LINES)} SELECT invoice_no, string_agg(DISTINCT business_no, ',' ORDER BY business_no) AS lines FROM lines WHERE role = 'invoice' AND length(invoice_no) >= 6 GROUP BY 1 HAVING count(DISTINCT business_no) > 1""")
def invoice_uniqueness(spark, d):
    return recon.invoice_uniqueness(t.line_documents(spark, d)).withColumn("lines", F.array_join("lines", ","))



@query("diff_closure", f"""{with_(LEDGER, LINES, UNIQ, CELLS, R1)}, k AS (SELECT DISTINCT business_no, direction || role || type AS key, severity, CAST(business_no AS BIGINT) AS n FROM r1),
 o AS (SELECT business_no, key, severity, CASE n % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'pending' END AS resolution FROM k WHERE n % 4 <> 0), w AS (SELECT * FROM k WHERE n % 5 <> 0)
 SELECT coalesce(o.business_no, w.business_no) AS business_no, coalesce(o.key, w.key) AS key, coalesce(w.severity, o.severity) AS severity,
 CASE WHEN o.key IS NULL THEN 'new' WHEN w.key IS NULL THEN 'resolved' ELSE 'carried' END AS state, resolution, coalesce(resolution IN ('ignore', 'false_positive'), false) AS closed
 FROM o FULL JOIN w ON o.business_no = w.business_no AND o.key = w.key""")
def diff_closure(spark, d):
    rows = recon.r1_completeness(*both(spark, d)).select("business_no", F.concat("direction", "role", "type").alias("key"), "severity", F.col("business_no").cast("long").alias("n")).distinct()
    rows = written(rows, "run")  # both runs are drawn from it
    resolution = F.when(F.col("n") % 3 == 0, "ignore").when(F.col("n") % 3 == 1, "pending")
    return recon.closure(rows.filter("n % 4 <> 0").withColumn("resolution", resolution), rows.filter("n % 5 <> 0"))


@query("report_change_feed", f"""{with_(LEDGER, LINES)}, a AS (SELECT business_no, CASE WHEN pay_amount IS NULL THEN 'warning' ELSE 'ok' END AS status, CAST(business_no AS BIGINT) % 4 AS n_diffs FROM ledger),
 b AS (SELECT business_no, 'ok' AS status, CAST(business_no AS BIGINT) % 4 AS n_diffs FROM ledger WHERE CAST(business_no AS BIGINT) % 10 > 0)
 SELECT a.business_no, b.status AS old_status, a.status, b.n_diffs AS old_n, a.n_diffs FROM a LEFT JOIN b ON a.business_no = b.business_no WHERE b.business_no IS NULL OR a.status <> b.status""")
def report_change_feed(spark, d):
    lines = t.ledger(spark, d).select("business_no", F.when(F.col("pay_amount").isNull(), "warning").otherwise("ok").alias("status"), (F.col("business_no").cast("long") % 4).alias("n_diffs"))
    return recon.changed(lines.filter("CAST(business_no AS BIGINT) % 10 > 0").withColumn("status", F.lit("ok")), lines)


@query("report_upsert", """SELECT CAST(o_orderkey AS VARCHAR) AS business_no, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS status FROM orders""")
def report_upsert(spark, d):
    lines = t.ledger(spark, d).select("business_no")
    return recon.upsert_reports(lines.withColumn("status", F.lit("old")), lines.filter("CAST(business_no AS BIGINT) % 2 = 0").withColumn("status", F.lit("new")))


@query("diff_keys", f"{with_(LINES)} SELECT document_id, substr(sha1(concat_ws('|', 'x', direction, role, coalesce(CAST(amount AS VARCHAR), ''), '', document_id)), 1, 12) AS key FROM lines")
def diff_keys(spark, d):
    docs = t.line_documents(spark, d)
    key = diff_key(F.lit("x"), F.col("direction"), F.col("role"), F.col("amount").cast("string"), F.lit(None).cast("string"), F.array("document_id"))
    return docs.select("document_id", key.alias("key"))


@query("variant_join", f"{with_(LINES)} SELECT document_id, business_no FROM lines JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS business_no FROM orders) USING (business_no)")
def variant_join(spark, d):
    lines, docs = both(spark, d)
    return joins.variant_join(docs.drop("business_no"), lines, ["contract_no"], ["up_contract_no", "down_contract_no"], "document_id", "business_no")


@query("unlinked_docs", f"""{with_(LINES)} SELECT document_id, 'contract number unknown' AS reason FROM lines WHERE CAST(business_no AS BIGINT) % 2 = 1""")
def unlinked_docs(spark, d):
    lines, docs = both(spark, d)
    half = lines.filter("CAST(business_no AS BIGINT) % 2 = 0")
    bound = joins.variant_join(docs.drop("business_no"), half, ["contract_no"], ["up_contract_no", "down_contract_no"], "document_id", "business_no")
    return joins.anti_with_reason(docs, bound, "document_id", "contract_no").select("document_id", "reason")


@query("amount_tolerance_join", """WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_totalprice AS DECIMAL(18,2)) AS x FROM orders), b AS (SELECT c_custkey AS b, CAST(c_acctbal AS DECIMAL(18,2)) AS y FROM customer)
 SELECT a, b, x, y FROM a JOIN b ON abs(x - y) <= 5""")
def amount_tolerance_join(spark, d):
    a = t.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    b = t.table(spark, d, "customer").select(F.col("c_custkey").alias("b"), F.col("c_acctbal").cast("decimal(18,2)").alias("y"))
    return joins.tolerance_join(a, b, "x", "y", "5")


@query("unique_hit", """WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_totalprice AS DECIMAL(18,2)) AS x FROM orders), b AS (SELECT c_custkey AS b, CAST(c_acctbal AS DECIMAL(18,2)) AS y FROM customer),
 j AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS n FROM a JOIN b ON abs(x - y) <= 5) SELECT a, b FROM j WHERE n = 1""")
def unique_hit(spark, d):
    return joins.unique_hits(amount_tolerance_join(spark, d).select("a", "b"), "a")


@query("name_match_join", """WITH n AS (SELECT DISTINCT n_name AS word FROM nation UNION SELECT r_name FROM region), p AS (SELECT DISTINCT p_name || ' ' || p_type AS text FROM part)
 SELECT DISTINCT text, w AS word FROM p, (SELECT DISTINCT split_part(p_type, ' ', 1) AS w FROM part) WHERE contains(text, w)""")
def name_match_join(spark, d):
    parts = t.table(spark, d, "part")
    texts = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("text"))
    words = parts.select(F.split("p_type", " ")[0].alias("word"))
    return joins.containment_join(texts, words, "text", "word")


@query("cascade_lookup", """WITH r AS (SELECT p_partkey AS ref_id, p_name, p_brand, p_type, p_size FROM part), q AS (SELECT l_partkey AS id, l_linenumber AS n, l_orderkey AS o FROM lineitem WHERE l_linenumber = 1),
 a AS (SELECT DISTINCT id FROM q), e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'none' END AS name, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'none' END AS brand, p_type AS type, p_size AS size FROM part),
 k1 AS (SELECT p_name, min(ref_id) AS ref_id FROM r GROUP BY 1), k2 AS (SELECT p_brand, p_size, p_type, min(ref_id) AS ref_id FROM r GROUP BY 1, 2, 3 HAVING count(*) = 1), k3 AS (SELECT p_type, p_size, min(ref_id) AS ref_id FROM r GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT e.id, coalesce(k1.ref_id, k2.ref_id, k3.ref_id) AS ref_id, CASE WHEN k1.ref_id IS NOT NULL THEN 'name' WHEN k2.ref_id IS NOT NULL THEN 'brand' ELSE 'type' END AS matched_by
 FROM e LEFT JOIN k1 ON name = k1.p_name LEFT JOIN k2 ON brand = k2.p_brand AND size = k2.p_size AND type = k2.p_type LEFT JOIN k3 ON type = k3.p_type AND size = k3.p_size WHERE coalesce(k1.ref_id, k2.ref_id, k3.ref_id) IS NOT NULL""")
def cascade_lookup(spark, d):
    parts = t.table(spark, d, "part")
    c, k = F.col, F.col("p_partkey") % 3
    rows = parts.select(c("p_partkey").alias("id"), F.when(k == 0, c("p_name")).otherwise("none").alias("name"), F.when(k == 1, c("p_brand")).otherwise("none").alias("brand"), c("p_type").alias("type"), c("p_size").alias("size"))
    reference = parts.withColumnRenamed("p_partkey", "ref_id")
    steps = [("name", [c("name")], [c("p_name")], False), ("brand", [c("brand"), c("size"), c("type")], [c("p_brand"), c("p_size"), c("p_type")], True), ("type", [c("type"), c("size")], [c("p_type"), c("p_size")], True)]
    return joins.cascade_lookup(rows, reference, "id", steps)


@query("ledger_merge", """WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) AS business_no, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag, CAST(l_shipdate AS DATE) AS day, l_linestatus AS st FROM lineitem),
 f AS (SELECT business_no, st, min(pos) AS pos FROM x WHERE st <> '' GROUP BY 1, 2)
 SELECT business_no, sum(amount) AS amount, arg_min(flag, pos) FILTER (flag <> '') AS flag, arg_min(day, pos) AS day, (SELECT string_agg(st, ',' ORDER BY f.pos) FROM f WHERE f.business_no = x.business_no) AS st_list FROM x GROUP BY 1""")
def ledger_merge(spark, d):
    items = t.table(spark, d, "lineitem")
    rows = items.select(
        F.col("l_orderkey").cast("string").alias("business_no"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("flag"), F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("st"),
    )
    return ledger.merge_lines(rows, "business_no", "pos", ["amount"], ["flag"], ["day"], ["st"]).withColumn("st_list", F.array_join("st_list", ","))


@query("settlement_sums", """SELECT upper(l_returnflag) AS contract_key, sum(coalesce(CASE WHEN l_linenumber > 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END, CAST(l_quantity AS DECIMAL(18,2)) + 1)) AS up_settlement,
 sum(CAST(l_tax * 100 AS DECIMAL(18,2))) AS down_settlement, CAST(0 AS DECIMAL(18,2)) AS interest FROM lineitem GROUP BY 1""")
def settlement_sums(spark, d):
    money = lambda c: c.cast("decimal(18,2)")
    rows = t.table(spark, d, "lineitem").select(
        F.concat(F.lit(" "), "l_returnflag", F.lit("）")).alias("no"), F.when(F.col("l_linenumber") > 1, money(F.col("l_extendedprice"))).alias("total"), money(F.col("l_quantity")).alias("purchase"),
        money(F.lit(1)).alias("tail"), F.lit(None).cast("decimal(18,2)").alias("tail_invoice"), money(F.col("l_tax") * 100).alias("sale"), F.lit(None).cast("decimal(18,2)").alias("interest"),
    )
    return ledger.settlement_sums(rows, "no")


@query("payment_sums", """SELECT upper(l_returnflag) || l_linenumber AS contract_key, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS pay_amount, sum(coalesce(CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS DECIMAL(18,2)) END, 0)) AS receipt_amount,
 CAST(sum(CAST(l_tax * 100 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS interest_receivable, CAST(0 AS DECIMAL(18,2)) AS interest_received,
 arg_min(l_shipmode, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) FILTER (l_shipmode <> 'AIR') AS up_contract_no, min(CAST(l_shipdate AS DATE)) AS invoice_date FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'AIR' ELSE 'N' || l_suppkey END AS l_shipmode FROM lineitem) GROUP BY 1""")
def payment_sums(spark, d):
    money = lambda c: c.cast("decimal(18,2)")
    rows = t.table(spark, d, "lineitem").select(
        F.concat(F.lower("l_returnflag"), F.col("l_linenumber").cast("string"), F.lit(")")).alias("no"), money(F.col("l_extendedprice")).alias("pay_amount"), F.when(F.col("l_linenumber") > 2, money(F.col("l_quantity"))).alias("receipt_amount"),
        money(F.col("l_tax") * 100).alias("interest_receivable"), F.lit(None).cast("decimal(18,2)").alias("interest_received"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("N"), F.col("l_suppkey").cast("string"))).alias("up_contract_no"),
        F.to_date("l_shipdate").alias("invoice_date"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return ledger.payment_sums(rows, "no", "pos")


@query("containment_join", """WITH w AS (SELECT DISTINCT r_name AS word FROM region UNION SELECT n_name FROM nation UNION SELECT unnest(['the', 'de', 'x', 'rights', 'a b']))
 SELECT doc_id, word FROM documents, w WHERE contains(coalesce(text, ''), word)""")
def containment_join(spark, d):
    """Whole texts of all documents against names and short words."""
    names = t.table(spark, d, "region").select(F.col("r_name").alias("word")).union(t.table(spark, d, "nation").select("n_name"))
    words = names.union(spark.createDataFrame([("the",), ("de",), ("x",), ("rights",), ("a b",)], "word string"))
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    return joins.containment_join(docs, words, "text", "word", key="doc_id")


@query("image_duplicates", f"""{with_(LINES)}, p AS (SELECT document_id, business_no, direction, role, floor(amount / 20000) AS amount, CAST(regexp_extract(document_id, '(\\d+)$', 1) AS INT) % 3 AS h FROM lines WHERE direction IN ('up', 'down') AND amount IS NOT NULL),
 k AS (SELECT *, first_value(document_id) OVER (PARTITION BY business_no, direction, role, h, amount ORDER BY document_id) AS kept FROM p) SELECT document_id, kept AS kept_id FROM k WHERE kept <> document_id""")
def image_duplicates(spark, d):
    """WIN-04, JON-27: copies within a cell by three pictures; different amounts, in steps here, contradict."""
    docs = t.line_documents(spark, d).filter("direction IN ('up', 'down') AND amount IS NOT NULL").withColumn("amount", (F.floor(F.col("amount") / 20000) * 20000).cast("decimal(18,2)"))
    number = F.element_at(F.split("document_id", "-"), -1).cast("int") % 3
    prints = docs.withColumns({"phash": F.element_at(F.array(F.lit("0" * 16), F.lit("f" * 16), F.lit("0f" * 8)), number + 1), "img_w": F.lit(9), "img_h": F.lit(8), "contract_no": F.lit("")})
    return recon.unique_in_cell(prints).filter("kept_id <> document_id").select("document_id", "kept_id")


@query("statement_mentions", """SELECT 'c' || o_custkey AS document_id, CAST(o_orderkey AS VARCHAR) AS business_no, 'statement' AS basis FROM orders WHERE o_orderkey % 3 > 0""")
def statement_mentions(spark, d):
    """JON-14: a statement for each customer that lists the tails of its orders' numbers; a third of them it doesn't name."""
    k = F.col("o_orderkey").cast("string")
    tail = F.lpad(k, 12, "0")
    orders = t.table(spark, d, "orders").select(k.alias("business_no"), F.concat(F.lit("HSYCXS-2026-"), tail).alias("down_contract_no"), F.lit("").alias("up_contract_no"), tail.alias("tail"), "o_custkey", (F.col("o_orderkey") % 3 > 0).alias("named"))
    # Lists of at most four tails, so that each begins within forty characters.
    lists = orders.filter("named").withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("business_no")) - 1) / 4))
    lists = lists.groupBy("o_custkey", "_k").agg(F.concat(F.lit("业务 HSYCXS\n-2026 -"), F.array_join(F.sort_array(F.collect_list("tail")), " /"), F.lit("，共 20.26 元。")).alias("text"))
    docs = lists.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    docs = docs.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("document_id"), F.lit("other").alias("role"), "text")
    return recon.statements(orders, docs, ["up_contract_no", "down_contract_no"])
