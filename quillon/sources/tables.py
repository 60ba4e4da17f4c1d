"""The engine's relations, adapted from the generic tables (orders as ledger, lineitem as documents, and so on)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-01."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """id, original_filename, document_type, source, extracted_text, file_hash, file_size, status (by label)."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "archived").when(F.col("quality") == 0, "need_review").otherwise("pending")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("original_filename"),
        F.col("lang").alias("document_type"),
        "source",
        F.col("text").alias("extracted_text"),
        F.sha2("text", 256).alias("file_hash"),
        F.col("n_chars").alias("file_size"),
        status.alias("status"),
    )


def fields(spark: SparkSession, folder: str) -> DataFrame:
    """Entity-attribute-value rows of orders: id, document_id, field_name, field_value, confidence, source."""
    orders = table(spark, folder, "orders")
    values = {
        "status": F.col("o_orderstatus"),
        "category": F.col("o_orderpriority"),
        "amount": F.col("o_totalprice").cast(MONEY).cast("string"),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
    }
    rows = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("field_name"), v.alias("field_value")) for k, (name, v) in enumerate(values.items())]
    long = orders.select("o_orderkey", F.inline(F.array(*rows)))
    return long.select(
        (F.col("o_orderkey") * 10 + F.col("k")).alias("id"),
        F.col("o_orderkey").alias("document_id"),
        "field_name",
        "field_value",
        F.lit(0.9).alias("confidence"),
        F.lit("RULE").alias("source"),
    )


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """The operation log from events: id, job_id, operation_type, result, created_at."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("operation_type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("result"),
        F.col("ts").alias("created_at"),
        "value",
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Business lines from orders: one upstream and one downstream side whose amounts derive from the price."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").dropDuplicates(["c_custkey"])  # so that the join goes where no customer is read
    total = F.col("o_totalprice").cast(MONEY)
    key = F.col("o_orderkey").cast("string")
    third = F.pmod("o_orderkey", F.lit(3))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        key.alias("business_no"),
        F.concat(F.lit("CG-"), key).alias("up_contract_no"),
        F.concat(F.lit("XS-"), key).alias("down_contract_no"),
        F.col("c_name").alias("customer"),
        F.col("c_mktsegment").alias("segment"),
        total.alias("up_contract_amount"),
        total.alias("up_settlement"),
        (total + 1000).cast(MONEY).alias("down_settlement"),
        F.when(third > 0, total).alias("pay_amount"),
        (total + 1000).cast(MONEY).alias("receipt_amount"),
        F.when(third == 0, F.lit(1000)).when(third == 1, F.lit(1500)).cast(MONEY).alias("interest_receivable"),
        F.when(third == 0, F.lit(900)).when(third == 1, F.lit(1400)).cast(MONEY).alias("interest_received"),
        F.to_date("o_orderdate").alias("up_contract_date"),
        F.to_date("o_orderdate").alias("down_contract_date"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
    )


def _line_document() -> dict[str, Column]:
    """A document's columns by lineitem's."""
    role = (
        F.when(F.col("l_returnflag") == "R", "payment_receipt").when(F.pmod("l_linenumber", F.lit(2)) == 0, "invoice").otherwise("settlement")
    )
    direction = F.when(F.col("l_linestatus") == "O", "up").otherwise("down")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return {
        "document_id": key,
        "business_no": F.col("l_orderkey").cast("string"),
        "contract_no": F.concat(F.when(direction == "up", "cg").otherwise("xs"), F.lit("（DD） -"), F.col("l_orderkey").cast("string")),
        "direction": direction,
        "role": role,
        "nature": F.when(F.col("l_tax") >= 0.08, "deposit").otherwise("payment"),
        "amount": F.when(F.col("l_discount") < 0.095, F.col("l_extendedprice").cast(MONEY)),
        "doc_date": F.to_date("l_shipdate"),
        "invoice_no": F.concat(F.lit("INV"), F.col("l_partkey").cast("string")),
        "seller": F.col("s_name"),
        "filename": F.concat(role, F.lit("-"), key, F.lit(".pdf")),
    }


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of business lines from lineitem; the four-part key is the document's id, since order and number
    repeat."""
    items = table(spark, folder, "lineitem")
    suppliers = table(spark, folder, "supplier").dropDuplicates(["s_suppkey"])  # so that the join goes where no name is read
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(*[c.alias(n) for n, c in _line_document().items()])


def named_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger with names of parties and a vessel that are each line's own."""
    key = F.col("business_no")
    return ledger(spark, folder).withColumns({"supplier": F.concat(F.lit("Works-"), key, F.lit(" Ltd")), "customer": F.concat(F.lit("Client-"), key, F.lit(" Ltd")), "vessel": F.concat(F.lit("MV"), key, F.lit("X"))})


def loose_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that aren't bound to lines, from lineitem: a fifth each has a contract number, the purchase's or the sale's
    amount, the seller's name alone, or is a cargo document that names vessel and receiver."""
    # Joined by the numbers of lineitem, from which texts are made afterwards: texts are wider and would be shuffled.
    total = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("_total"))
    number = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(5))
    kind, key = F.col("_kind"), F.col("business_no")
    rows = table(spark, folder, "lineitem").join(total, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(*[c.alias(n) for n, c in _line_document().items() if n != "seller"], number.alias("_kind"), "_total")
    ship = F.concat(F.lit("船名 MV"), key, F.lit("X，货物转移给Client-"), key, F.lit("有限公司。"))
    return rows.select(
        "document_id",
        F.when(kind == 0, F.col("contract_no")).alias("contract_no"),
        F.lit("unknown").alias("direction"),
        F.when(kind == 4, "cargo_right").otherwise(F.col("role")).alias("role"),
        "nature",
        F.when(kind == 0, F.col("amount")).when(kind == 1, F.col("_total")).when(kind == 2, (F.col("_total") + 1000).cast(MONEY)).alias("amount"),
        "doc_date",
        "invoice_no",
        F.when(kind == 3, F.concat(F.lit("Works-"), key, F.lit(" Ltd"))).alias("seller"),
        F.lit(None).cast("string").alias("company"),
        F.when(kind == 4, ship).alias("text"),
        "filename",
    )


def split_payments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Lines whose payment is the sum of their first three numbers, and their receipts, of unknown side."""
    items = table(spark, folder, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("document_id"),
        F.col("l_orderkey").cast("string").alias("business_no"),
        F.lit("unknown").alias("direction"),
        F.lit("payment_receipt").alias("role"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        "l_linenumber",
    )
    lines = items.groupBy("business_no").agg(F.sum(F.when(F.col("l_linenumber") <= 3, F.col("amount"))).cast(MONEY).alias("pay_amount"))
    return lines, items.drop("l_linenumber")


def details(spark: SparkSession, folder: str) -> DataFrame:
    """External details from lineitem: id, batch_no, business_no, occurred_on, amount, kind."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return table(spark, folder, "lineitem").select(
        key.alias("id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("batch_no"),
        F.col("l_orderkey").cast("string").alias("business_no"),
        F.to_date("l_shipdate").alias("occurred_on"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "payment").otherwise("receipt").alias("kind"),
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """A category tree from regions and nations: id, parent_id, name."""
    regions = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    nations = table(spark, folder, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    return regions.unionByName(nations)
