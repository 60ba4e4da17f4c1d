"""Status changes, recycling, undo, logs, exports, snapshots (section 2.2 and 2.12), each a new table from an old one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import ranked

REVERSIBLE = ["archive", "rename", "review", "recycle"]


def outcome(decision: Column, duplicate_of: Column, error: Column) -> Column:
    """DML-01, DML-11: the status in which a file leaves the pipeline."""
    return (
        F.when(error.isNotNull(), "failed").when(duplicate_of.isNotNull(), "duplicate").when(decision == "auto", "archived").otherwise("need_review")
    )


def set_status(docs: DataFrame, ids: DataFrame, status: str, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT-15, DML-07: the documents with the asked ids in a new status, and a row of result for each asked id: ok, not_found or
    wrong_status."""
    asked = ids.select("id").distinct()
    may = F.lit(True) if allowed is None else F.col("status").isin(*allowed)
    marked = docs.join(asked.withColumn("_asked", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_asked"), F.lit(False)) & may
    changed = marked.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).drop("_asked")
    result = asked.join(docs.select("id", "status"), "id", "left").select("id", F.when(F.col("status").isNull(), "not_found").when(may, "ok").otherwise("wrong_status").alias("result"))
    return changed, result


def recycle(docs: DataFrame, ids: DataFrame, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """SNK-07: the documents, those ids recycled, and the bin's rows with the status they had."""
    gone = docs.join(ids.select("id").distinct(), "id", "left_semi").filter("status <> 'recycled'")
    rows = gone.select(F.col("id").alias("document_id"), F.col("status").alias("original_status"), F.lit(reason).alias("deleted_reason"), at.alias("deleted_at"))
    return set_status(docs, ids, "recycled")[0], rows


def restore(docs: DataFrame, recycled: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-07: the documents with their old status again, and the bin without them."""
    back = recycled.join(ids.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    rows = docs.join(back.select(F.col("document_id").alias("id"), "original_status"), "id", "left")
    rows = rows.withColumn("status", F.coalesce("original_status", "status")).drop("original_status")
    return rows, recycled.join(back.select("document_id"), "document_id", "left_anti")


def without_batch(rows: DataFrame, column: str, value: str) -> DataFrame:
    """SNK-09: all rows but one batch's; rows whose batch is null stay."""
    return rows.filter(~F.col(column).eqNullSafe(F.lit(value)))


def last_reversible(log: DataFrame, kinds: list[str] = REVERSIBLE) -> DataFrame:
    """WIN-08, DML-06: the operation of each document that an undo would take back: its newest of a reversible kind that went well."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = log.filter(F.col("operation_type").isin(*kinds) & (F.col("result") == "ok"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def undone(docs: DataFrame, operations: DataFrame) -> DataFrame:
    """DML-06: the documents with the old names and statuses of the operations to take back."""
    back = operations.select(F.col("document_id").alias("id"), "old_filename", "old_status")
    rows = docs.join(back, "id", "left")
    return rows.withColumns({"current_filename": F.coalesce("old_filename", "current_filename"), "status": F.coalesce("old_status", "status")}).drop("old_filename", "old_status")


def log_page(log: DataFrame, kind: str | None = None, path: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """FLT-08."""
    rows = log if kind is None else log.filter(F.col("operation_type") == kind)
    if path:
        rows = rows.filter(F.col("old_path").ilike(f"%{path}%") | F.col("new_path").ilike(f"%{path}%"))
    return rows.orderBy(F.desc("id")).offset(offset).limit(limit)


def log_rows(results: DataFrame, kind: str, at: Column) -> DataFrame:
    """SNK-03, SNK-04: log rows of a batch operation's results."""
    return results.select(F.col("id").alias("document_id"), F.lit(kind).alias("operation_type"), F.when(F.col("result") == "ok", "ok").otherwise("failed").alias("result"), F.nullif(F.col("result"), F.lit("ok")).alias("error_message"), at.alias("created_at"))


def archive(docs: DataFrame, folder: str, by: list[str]) -> None:
    """SNK-01, UDF-04: the archive as a partitioned table; the partition columns are the directory template."""
    docs.repartition(*by).write.mode("append").partitionBy(*by).parquet(folder)


def unique_names(docs: DataFrame, folder: Column, name: Column, key: str = "id", taken: DataFrame | None = None) -> DataFrame:
    """FN-21: file names that are unique in their directory: the second of a name gets _001, and so on, by id; beyond 999 the
    number is as long as it must be.  Numbers that names of the directory have already, among the documents or in `taken` (directory,
    filename), aren't given again: a name goes on behind the largest."""
    rows = ranked(docs.select(key, folder.alias("directory"), name.alias("_name")), ["directory", "_name"], [key], "_n")
    split = r"^(.*?)(\.[^.]*)?$"
    stem, ext = F.regexp_extract("_name", split, 1), F.regexp_extract("_name", split, 2)
    there = rows.select("directory", F.col("_name").alias("_there"), F.lit(0).alias("_taken")).distinct()
    if taken is not None:
        there = there.union(taken.select("directory", "filename", F.lit(1)))
    own, suffix = F.regexp_extract("_there", split, 1), F.regexp_extract("_there", r"_(\d{3,18})(\.[^.]*)?$", 1)
    numbers = there.filter(suffix != "").select("directory", F.concat(F.regexp_replace(own, r"_\d{3,18}$", ""), F.regexp_extract("_there", split, 2)).alias("_name"), suffix.cast("long").alias("_number"))
    plain = there.filter("_taken = 1").select("directory", F.col("_there").alias("_name"), F.lit(None).cast("long").alias("_number"))
    first = numbers.withColumn("_plain", F.lit(0)).union(plain.withColumn("_plain", F.lit(1))).groupBy("directory", "_name").agg(F.max("_number").alias("_number"), F.max("_plain").alias("_plain"))
    rows = rows.join(first.select(F.col("directory").alias("_d"), F.col("_name").alias("_p"), "_number", "_plain"), F.col("directory").eqNullSafe(F.col("_d")) & (F.col("_name") == F.col("_p")), "left")
    n = F.col("_n") + F.coalesce("_plain", F.lit(0))
    number = n + F.coalesce("_number", F.lit(0))
    text = number.cast("string")
    numbered = F.concat(stem, F.lit("_"), F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text), ext)
    return rows.select(key, "directory", F.when(n > 0, numbered).otherwise(F.col("_name")).alias("filename"))


def export_tables(status: DataFrame, diffs: DataFrame, unlinked: DataFrame) -> dict[str, DataFrame]:
    """SNK-03: the four sheets of the report: lines, differences, missing documents, documents without a line."""
    lists = {"document_ids": F.array_join("document_ids", ",")}
    flat = diffs.withColumns(lists)
    return {"lines": status, "differences": flat, "missing": flat.filter("type = 'missing_doc'"), "unlinked": unlinked}


def write_export(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(kind).save(f"{folder}/{name}")


def counted(rows: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict:
    """AGG-27, AGG-38, STR-05: writes the rows and returns aggregates of them, which the job that writes observes on its way."""
    seen = Observation()
    write(rows.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return seen.get


def backup(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """SNK-06, AGG-38: a snapshot of tables, and their numbers of rows, counted while they are written."""
    put = lambda name: lambda df: df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return {name: counted(df, put(name), n=F.count("*"))["n"] for name, df in tables.items()}


def restored(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """SNK-06."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def category_errors(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """DML-09: changes (id, parent_id, name, delete) that would give a path twice or take a parent from its children."""
    twin = changes.filter("NOT delete").join(categories.select(F.col("parent_id").alias("_p"), F.col("name").alias("_n"), F.col("id").alias("_id")), (F.col("name") == F.col("_n")) & F.col("parent_id").eqNullSafe(F.col("_p")) & ~F.col("id").eqNullSafe(F.col("_id")))
    parent = changes.filter("delete").join(categories.select(F.col("parent_id").alias("_p")).distinct(), F.col("id") == F.col("_p"))
    return twin.select("id", F.lit("path exists").alias("error")).unionByName(parent.select("id", F.lit("has children").alias("error"))).distinct()
