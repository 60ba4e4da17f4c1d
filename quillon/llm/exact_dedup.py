"""Exact de-duplication by skew-safe combining, with DataFrame functions alone.

Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D].  Of equal texts stays
the row with the most code points, then the smallest id.

1. Local: the partial aggregation of each scan task joins the copies that the task has read.
2. Salted: what the tasks found meets by digest, salt and full text; the salt is the scan task's number,
   so the rows of a hot text are dealt over `salts` reducers and are one per scan task at most.
3. Global: the at most `salts` winners of a text meet by digest and full text.

The label of each class (digest, id that stays, size) then goes back to the rows by a lookup in which
the classes that hold many rows are broadcast (common.lookup).

Null text counts as empty, and all empty texts are one class.  A null id ranks behind all other ids and
is kept only if nothing else can be.  Exactly one row of a class stays: of rows with the same id and number of
code points, the first by the number that it got when the rows were written.  Columns besides id and text are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written

#: More than the distance of any two ids, so that `code points * SPAN + distance to the largest id` keeps both.
SPAN = "20000000000000000000"
LAST = "9223372036854775807"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the normalised text, in hex), chars of the text, and row, a number for each row."""
    chars = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"), chars.alias("chars"))
    return slim.withColumn("row", F.monotonically_increasing_id())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each distinct text: digest, keep_id, keep_chars, group_size."""
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    chars = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    nearness = F.coalesce(wide(F.lit(LAST), 20) - wide(F.col(id_col), 20), wide(F.lit(-1), 20))
    ranked = docs.select(
        normalised(F.col(text_col)).alias("content"),
        (wide(chars, 12) * wide(F.lit(SPAN), 20) + nearness + wide(F.lit(1), 20)).cast("decimal(38,0)").alias("rank"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).withColumn("digest", F.sha2("content", 256))
    salted = ranked.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    best = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    near, span = F.col("rank") % wide(F.lit(SPAN), 38), wide(F.lit(SPAN), 38)
    keep = F.when(near > 0, (wide(F.lit(LAST), 38) + wide(F.lit(1), 38) - near).cast("long"))
    return best.select("digest", keep.alias("keep_id"), F.floor((F.col("rank") - near) / span).cast("int").alias("keep_chars"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each row of `docs`: its id, keep_id, group_size, kept, text_sha256."""
    slim = written(numbered(docs, id_col, text_col), "exact-rows")
    best = classes(docs, id_col, text_col, salts)
    again = slim.groupBy("digest", "id", "chars").agg(F.min("row").alias("keep_row"), F.count("*").alias("times")).filter("times > 1")
    again = again.select("keep_row", F.col("digest").alias("d"), F.col("id").alias("i"), F.col("chars").alias("c"))
    same = (F.col("digest") == F.col("d")) & F.col("keep_id").eqNullSafe(F.col("i")) & (F.col("keep_chars") == F.col("c"))
    found = written(best.join(again, same, "left").drop("d", "i", "c"), "exact-classes")
    labelled = lookup(slim, found, "digest", "group_size", slim.count(), "row")
    first = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))
    return labelled.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & first).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
