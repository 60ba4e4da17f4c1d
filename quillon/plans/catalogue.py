"""The engine's queries over the generic tables, each with the SQL that must give the same rows.

A query is a function of (spark, folder); @query registers it under its name together with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The adapted relations of sources.tables as common table expressions.
DOCS = """docs AS (
  SELECT d.doc_id AS id, source || '-' || d.doc_id || '.txt' AS original_filename, lang AS document_type, source, text AS extracted_text,
         sha256(text) AS file_hash, n_chars AS file_size,
         CASE WHEN quality = 1 THEN 'archived' WHEN quality = 0 THEN 'need_review' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
FIELDS = """fields AS (
  SELECT o_orderkey * 10 + k AS id, o_orderkey AS document_id, field_name, field_value, 0.9 AS confidence, 'RULE' AS source FROM (
    SELECT o_orderkey, 0 AS k, 'status' AS field_name, o_orderstatus AS field_value FROM orders
    UNION ALL SELECT o_orderkey, 1, 'category', o_orderpriority FROM orders
    UNION ALL SELECT o_orderkey, 2, 'amount', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders
    UNION ALL SELECT o_orderkey, 3, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders))"""
OPS = """ops AS (
  SELECT event_id AS id, user_id AS job_id, event_type AS operation_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS result,
         ts AS created_at, value FROM events)"""
LEDGER = """ledger AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS business_no, c_name AS customer, c_mktsegment AS segment, t AS up_contract_amount, t AS up_settlement,
         CAST(t + 1000 AS DECIMAL(18,2)) AS down_settlement, CASE WHEN m > 0 THEN t END AS pay_amount, CAST(t + 1000 AS DECIMAL(18,2)) AS receipt_amount,
         CAST(CASE m WHEN 0 THEN 1000 WHEN 1 THEN 1500 END AS DECIMAL(18,2)) AS interest_receivable,
         CAST(CASE m WHEN 0 THEN 900 WHEN 1 THEN 1400 END AS DECIMAL(18,2)) AS interest_received,
         CAST(o_orderdate AS DATE) AS up_contract_date, CAST(o_orderdate AS DATE) AS down_contract_date, strftime(o_orderdate, '%Y-%m') AS period
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS t, o_orderkey % 3 AS m FROM orders) o LEFT JOIN customer ON o_custkey = c_custkey)"""
LINES = """lines AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS document_id, CAST(l_orderkey AS VARCHAR) AS business_no,
         CASE WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS direction,
         CASE WHEN l_returnflag = 'R' THEN 'payment_receipt' WHEN l_linenumber % 2 = 0 THEN 'invoice' ELSE 'settlement' END AS role,
         CASE WHEN l_tax >= 0.08 THEN 'deposit' ELSE 'payment' END AS nature,
         CASE WHEN l_discount < 0.095 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
         CAST(l_shipdate AS DATE) AS doc_date, 'INV' || l_partkey AS invoice_no
  FROM lineitem)"""
DETAILS = """details AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, strftime(l_shipdate, '%Y-%m') AS batch_no,
         CAST(l_orderkey AS VARCHAR) AS business_no, CAST(l_shipdate AS DATE) AS occurred_on, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN l_returnflag = 'R' THEN 'payment' ELSE 'receipt' END AS kind
  FROM lineitem)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
