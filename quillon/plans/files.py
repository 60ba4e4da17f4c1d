"""Queries of formats: tables that are written as workbooks, word files, archives and watched folders, and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sinks
from ..sources import readers, store, workbook
from ..sources import tables as t
from ..sources.files import contents, listing
from ..sources.shared import new_path
from ..streaming import jobs
from .catalogue import query

#: Rows of a sheet of workbook_configured, and rows after which it begins a new file.
SHEET, WORKBOOK = 50_000, 200_000


@query("workbook_orders", """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
 o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority || ' <&> 中' END AS note FROM orders""")
def workbook_orders(spark, d):
    """SNK-03, SRC-06: orders as workbooks of 5,000 rows, and back; the kinds of all columns but the price are inferred."""
    k = F.col("o_orderkey")
    orders = t.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate"),
        (k % 2 == 0).alias("even"), F.when(k % 5 > 0, F.concat("o_orderpriority", F.lit(" <&> 中"))).alias("note"),
    )
    folder = new_path(spark, "workbooks")
    sinks.write_workbooks({"orders": orders}, folder, rows_per_file=5000)
    inferred = spark.read.format("workbook").load(folder).schema
    kinds = T.StructType([T.StructField(f.name, T.DecimalType(18, 2) if f.name == "o_totalprice" else f.dataType) for f in inferred])
    return spark.read.format("workbook").schema(kinds).load(folder)


@query("workbook_contracts", """SELECT 'YC-' || o_orderkey AS business_no, 'CG(DD)-' || o_orderkey AS up_contract_no, 'A' || o_custkey AS up_alt_no, 'XS-' || o_orderkey AS down_contract_no, 'B' || o_custkey AS down_alt_no,
 CAST(o_totalprice AS DECIMAL(18,2)) AS up_contract_amount, CAST(o_orderdate AS DATE) AS up_contract_date, 'ship ' || o_custkey AS vessel FROM orders WHERE o_orderkey % 4 > 0""")
def workbook_contracts(spark, d):
    """SRC-10, SRC-11: the contract sheet beside another, found by a part of its name; lines without a business number are left out."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    orders = t.table(spark, d, "orders")
    sheet = orders.select(
        F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("yc- "), k)).alias("业务线"), F.concat(F.lit("cg（DD）-"), k).alias("采购合同编号"), F.concat(F.lit("a"), c).alias("2.0编号"),
        F.to_date("o_orderdate").alias("采购合同签订日期"), F.col("o_totalprice").cast("decimal(18,2)").alias("采购合同金额"),
        F.concat(F.lit("xs-"), k).alias("销售合同编号OA"), F.concat(F.lit("b"), c).alias("2.0编号 "), F.concat(F.lit("ship "), c).alias("船名"),
    )
    folder = new_path(spark, "contracts")
    sinks.write_workbooks({"云创总合同2026": sheet, "other": orders.select("o_orderkey")}, folder)
    cells = sinks.cells_of(spark, folder, sheet="云创总合同")
    lines = workbook.contract_lines(cells.filter("row > 1"), sheet.columns)
    return lines.select("business_no", "up_contract_no", "up_alt_no", "down_contract_no", "down_alt_no", "up_contract_amount", "up_contract_date", "vessel")


@query("workbook_configured", """SELECT 'S-' || o_orderkey AS contract_no, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 > 0 THEN 'ship' END AS vessel, CAST(o_custkey AS VARCHAR) AS unit_price,
 CAST(o_custkey + 1 AS VARCHAR) AS unit_price_sale, 'S-' || o_orderkey || ',P-' || o_orderkey AS contracts FROM orders""")
def workbook_configured(spark, d):
    """SRC-12: sheets whose header stands below a title, with two price columns and two of contract numbers."""
    k = F.col("o_orderkey").cast("string")
    rows = t.table(spark, d, "orders").select(
        F.concat(F.lit("S-"), k).alias("a"), F.concat(F.lit("P-"), k).alias("b"), F.col("o_orderdate").alias("c"), F.when(F.col("o_orderkey") % 3 > 0, "ship").alias("d"), F.col("o_custkey").alias("e"), (F.col("o_custkey") + 1).alias("f")
    )
    names = ["销售合同编号", "采购合同编号", "日期", "船名", "单价", "单价"]
    out = sinks.workbook_rows(rows, "list").withColumn("header", F.array(F.lit("a title")))
    # The format writes the header first: a title stands there, and the real header is each file's first row.
    first = F.array(*[F.struct(F.lit("s").alias("t"), F.lit(n).alias("v")) for n in names])
    folder = new_path(spark, "configured")
    readers.register(spark)
    # Sheets of so many rows that each stays whole in its file: one that goes on in another file would have no header there.
    at = F.monotonically_increasing_id()
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    block = out.withColumn("_at", at).withColumn("sheet", F.concat_ws("-", "sheet", F.shiftright("_at", 33), F.floor(place / SHEET)))
    every = block.select("sheet", "header", "_at", F.posexplode(F.when(place % SHEET == 0, F.array(first, "cells")).otherwise(F.array("cells"))).alias("_k", "cells"))
    every = every.repartition("sheet").sortWithinPartitions("sheet", "_at", "_k").select("sheet", "header", "cells")
    every.to(T._parse_datatype_string(readers.SHEET_ROWS)).write.format("workbook").mode("append").option("wholeSheets", True).option("rowsPerFile", WORKBOOK).save(folder)
    found = workbook.configured_rows(sinks.cells_of(spark, folder))
    value = lambda f: F.col("fields")[f].alias(f)
    return found.select(value("contract_no"), value("date"), value("vessel"), value("unit_price"), value("unit_price_sale"), F.array_join("contracts", ",").alias("contracts"))


@F.pandas_udf(T.BinaryType())
def letter(name: pd.Series, balance: pd.Series) -> pd.Series:
    """A small word file: a heading, a paragraph and a table."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    from ..sources.office import WORD

    p = lambda text, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def one(n: str, b: str) -> bytes:
        row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
        heading = p(n, '<w:pPr><w:pStyle w:val="h"/></w:pPr>')
        body = f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>{heading}{p("  Dear " + n + " & co ")}<w:tbl>{row("name", "balance")}{row(n, b)}</w:tbl></w:body></w:document>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", body)
            z.writestr("word/styles.xml", f'<w:styles xmlns:w="{WORD[1:-1]}"><w:style w:styleId="h"><w:name w:val="heading 1"/></w:style></w:styles>')
        return out.getvalue()

    return pd.Series([one(n, b) for n, b in zip(name, balance, strict=True)])


@query("word_letters", """SELECT s_suppkey, '[标题] ' || s_name || chr(10) || 'Dear ' || s_name || ' & co' || chr(10) || '[表格]' || chr(10) || 'name | balance' || chr(10) || s_name || ' | ' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS text,
 CAST(s_acctbal AS DECIMAL(18,2)) AS balance FROM supplier""")
def word_letters(spark, d):
    """SRC-05: a word file for each supplier, archived and read again."""
    rows = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), letter("s_name", F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("content"))
    folder = new_path(spark, "letters")
    sinks.archived(rows, folder, F.lit("letters"), F.concat(F.col("id").cast("string"), F.lit(".docx")), F.col("content"))
    found = spark.read.format("word").load(folder)
    name = F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long")
    return found.select(name.alias("s_suppkey"), "text", F.col("tables")[0][1][1].cast("decimal(18,2)").alias("balance"))


@query("archived_files", """WITH n AS (SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS directory, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)
 SELECT c_custkey, directory, CASE WHEN k = 0 THEN 'letter.txt' WHEN k < 1000 THEN 'letter_' || lpad(CAST(k AS VARCHAR), 3, '0') || '.txt' ELSE 'letter_' || k || '.txt' END AS filename FROM n""")
def archived_files(spark, d):
    """SNK-01, SNK-12: a file for each customer, all of one name, in directories by segment and nation; the content tells which is which."""
    rows = t.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    folder = new_path(spark, "archive")
    sinks.archived(rows, folder, F.concat_ws("/", "c_mktsegment", "c_nationkey"), F.lit("letter.txt"), F.col("id").cast("string"))
    found = contents(listing(spark, folder))
    parts = F.split("path", "/")
    return found.select(F.col("content").cast("string").cast("long").alias("c_custkey"), F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2)).alias("directory"), F.element_at(parts, -1).alias("filename"))


@query("folder_versions", """SELECT s_suppkey, 1 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS versions,
 CASE WHEN s_suppkey % 5 = 0 THEN 'back' WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE 'new' END AS last FROM supplier""")
def folder_versions(spark, d):
    """SRC-17, STR-01: a folder with a file for each supplier that changes between runs of a stream: some grow, some go and come back."""
    base = new_path(spark, "watched")
    folder, work = f"{base}/in", f"{base}/work"
    keys = t.table(spark, d, "supplier").select("s_suppkey")

    def put(rows, word):
        rows.foreachPartition(lambda part: [store.put(f"{folder}/{r.s_suppkey}.txt", word.encode()) for r in part])

    readers.register(spark)

    def look():
        stream = spark.readStream.format("folder").option("state", f"{work}/state").load(folder)
        return jobs.run(stream.select("name", "version", F.col("content").cast("string").alias("text")), "append", f"{work}/checkpoint")

    put(keys, "new")
    look()
    put(keys.filter("s_suppkey % 3 = 0"), "changed")
    look()
    keys.filter("s_suppkey % 5 = 0").foreachPartition(lambda part: [store.delete(f"{folder}/{r.s_suppkey}.txt") for r in part])
    look()
    put(keys.filter("s_suppkey % 5 = 0"), "back")
    rows = look()
    key = F.regexp_extract("name", r"^(\d+)", 1).cast("long")
    return rows.groupBy(key.alias("s_suppkey")).agg(F.count("*").alias("versions"), F.max_by("text", "version").alias("last"))

