"""Line de-duplication against levelled sorted runs of line hashes, with DataFrame functions alone.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased.  Of the documents
that hold a key of at least `min_chars` code points, the one with the smallest id keeps its lines of this
key; the others lose theirs.

Documents come in batches by ascending id.  LineRuns holds the keys of earlier batches as runs: tables of
128-bit hashes, bucketed and sorted by hash.  A batch's own first holders are merge-anti-joined with one run after
another, which need neither a shuffle nor a sort for it; what is left is the batch's new run at level 0.  Once a level
has `fanout` runs, they are merged bucket by bucket into one run of the next level, so n batches leave at most
fanout * log(n) runs.  A line stays if its key and id are in the batch's new run; the other lines are dropped, found
by an anti-join on key and id, which no frequent line can make uneven.  Texts are read once for their lines, whose hashes
are written with each batch in a folder of its own; a task writes a file for each batch that it holds ids of.

Runs are external tables in the shared folder, in the session's current database under names of their own; they and the
lines are deleted in the end, also if a step fails.

Null text counts as empty: one empty line.  A null id counts as the largest id that there can be
(9223372036854775807; rows that have that id and rows that have none are one document).  Rows of the same
id are one document: each keeps the lines that the id may keep.  Columns besides id and text pass through, whatever
their names.  Ids are integers; others are cast, and fail if they can't be.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, remove

SPACE = " \t\n\x0b\x0c\r"
LAST = 9223372036854775807


#: Bytes of text of a batch, at most, if there are more than four batches.
BATCH = 1 << 40


class LineRuns:
    """The keys that were seen so far, as levelled sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, min_chars: int = 10, fanout: int = 4):
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.levels: list[list[str]] = []
        self.root = new_path(spark, "line-runs")
        self.name = "line_run_" + self.root[-32:]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = 0

    def lines(self, docs: DataFrame) -> DataFrame:
        """_ld_batch, _ld_id, _ld_row, _ld_pos and both halves of the key's hash, of each line that is long enough.  All batches are
        written at once, each in a folder of its own, so texts are read once however many batches there are."""
        text = F.coalesce(F.col("_ld_text"), F.lit(""))
        split = docs.select("_ld_batch", "_ld_id", "_ld_row", F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("_ld_pos", "_ld_line"))
        keyed = split.select("_ld_batch", "_ld_id", "_ld_row", "_ld_pos", F.btrim("_ld_line", F.lit(SPACE)).alias("_ld_key"))
        keyed = keyed.filter(F.char_length("_ld_key") >= self.min_chars)
        hashed = keyed.select(
            "_ld_id", "_ld_row", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h1"), F.xxhash64(F.lit("line"), "_ld_key").alias("_ld_h2"), "_ld_batch"
        )
        path = f"{self.root}/lines"
        hashed.write.partitionBy("_ld_batch").parquet(path)
        return self.spark.read.schema(hashed.schema).parquet(path)

    def write(self, keys: DataFrame) -> str:
        """A run of keys that are dealt by hash already, so that each bucket is one file."""
        self.made += 1
        run = f"{self.name}_{self.made}"
        out = keys.write.format("parquet").bucketBy(self.buckets, "_ld_h1", "_ld_h2").sortBy("_ld_h1", "_ld_h2")
        out.option("path", f"{self.root}/{run}").saveAsTable(run)
        return run

    def drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, f"{self.root}/{run}")

    def add(self, lines: DataFrame) -> str:
        """Takes the lines of a batch whose ids are larger than all before; the path of its dropped lines."""
        fresh = lines.groupBy("_ld_h1", "_ld_h2").agg(F.min("_ld_id").alias("_ld_first"))
        for run in (run for level in self.levels for run in level):
            fresh = fresh.join(self.spark.table(run).drop("_ld_first").hint("merge"), ["_ld_h1", "_ld_h2"], "left_anti")
        run = self.write(fresh)
        own = self.spark.table(run).withColumnRenamed("_ld_first", "_ld_id")
        dropped = lines.join(own.hint("merge"), ["_ld_h1", "_ld_h2", "_ld_id"], "left_anti")
        out = f"{self.root}/dropped-{self.made:06d}"
        dropped.select("_ld_id", "_ld_row", "_ld_pos").write.parquet(out)
        self.keep(run, 0)
        return out

    def keep(self, run: str, level: int) -> None:
        """Adds a run to a level, and compacts the level if it is full."""
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            # a union of tables that are bucketed alike is dealt as they are, and no key is in two runs
            all_ = reduce(DataFrame.unionByName, map(self.spark.table, old))
            merged = self.write(all_.groupBy("_ld_h1", "_ld_h2").agg(F.min("_ld_first").alias("_ld_first")))
            for run in old:
                self.drop(run)
            self.keep(merged, level + 1)

    def close(self) -> None:
        for run in (run for level in self.levels for run in level):
            self.drop(run)
        remove(self.spark, f"{self.root}/lines")


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Lets plans rely on the order of buckets of one file each."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int | None = None, fanout: int = 3,
    counts: bool = True,
) -> DataFrame:
    """The rows of `docs` with the lines that stay as their text, and with `counts` n_lines (before) and n_dropped, which take
    the place of columns of the same name.  `batches`: four, or more so that none holds over BATCH bytes."""
    spark = docs.sparkSession
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_ld_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_ld_row"),
        F.col(text_col).alias("_ld_text"),
    )
    wanted = batches or 4
    ranges = lambda n: F.percentile_approx("_ld_id", [k / n for k in range(1, n)], 10 * n + 1000) if n > 1 else F.array().cast("array<long>")
    size, cuts = slim.agg(F.sum(F.octet_length("_ld_text")), ranges(wanted)).first()
    if batches is None and (size or 0) > wanted * BATCH:
        cuts = slim.agg(ranges(math.ceil(size / BATCH))).first()[0]
    cuts = sorted(set(cuts or []))
    number = F.aggregate(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), F.lit(0), lambda n, c: n + F.when(F.col("_ld_id") >= c, 1).otherwise(0))
    runs, dropped = LineRuns(spark, min_chars, fanout), []
    with sorted_buckets(spark):
        try:
            lines = runs.lines(slim.withColumn("_ld_batch", number))
            for k in range(len(cuts) + 1):
                dropped.append(runs.add(lines.filter(F.col("_ld_batch") == k).drop("_ld_batch")))
        finally:
            runs.close()
    lost = spark.read.schema("_ld_id long, _ld_row long, _ld_pos int").parquet(*dropped)
    lost = lost.groupBy("_ld_id", "_ld_row").agg(F.collect_set("_ld_pos").alias("_ld_lost"))
    others = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    full = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_ld_own"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_ld_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_ld_row"),
    ).join(lost, ["_ld_id", "_ld_row"], "left")
    text = F.coalesce(F.col("_ld_own")[text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_lost"))
    full = full.withColumn("_ld_lines", lines).withColumn("_ld_stay", F.when(F.col("_ld_lost").isNotNull(), stay))
    n_lines = F.size("_ld_lines").cast("long").alias("n_lines")
    n_dropped = F.coalesce(F.size("_ld_lines") - F.size("_ld_stay"), F.lit(0)).cast("long").alias("n_dropped")
    kept = F.array_join(F.transform("_ld_stay", lambda k: F.get("_ld_lines", k)), "\n")
    return full.select(
        *[F.coalesce(kept, text).alias(c) if c == text_col else F.col("_ld_own")[c].alias(c) for c in others],
        *([n_lines, n_dropped] if counts else []),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.first_id <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (f.first_id IS NULL OR f.first_id = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key
GROUP BY k.doc_id
"""
