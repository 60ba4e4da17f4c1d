"""Structured Streaming (STR-01 to STR-06): ingest, de-duplication, windows, sessions, reconciliation by batch.

Each job takes a streaming DataFrame and gives one, or starts a query; run() drains what there is and returns the sink's rows.
Event times are cast to timestamps, since watermarks need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import state


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet*", files: int = 1) -> DataFrame:
    """STR-01: a table's file or folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
    return source.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{pattern}").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_windows(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """AGG-03 as a stream: tumbling days."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return w.select(F.to_date("window.start").alias("day"), "total", "failed")


def sliding_failures(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """AGG-06 as a stream: failures of seven days, day by day."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return w.select(F.to_date("window.start").alias("first_day"), "total", "failed")


def sessions(rows: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Sessions of users: events no further apart than the gap."""
    w = rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


def deduplicated(rows: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """STR-06, STR-02: the first row of each key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Drains a stream into files and returns all rows that it has given so far: those of this run, and, with a checkpoint that was
    used before, of the runs before.  The tasks write them; a batch that is repeated overwrites itself.  In complete mode the
    last batch holds everything."""
    spark, rows = stream.sparkSession, f"{checkpoint}/rows"

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{number:09d}")

    by_batch(stream, step, f"{checkpoint}/progress", mode)
    done = sorted(f.rpartition("/")[2] for f in folders(spark, rows))
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{rows}/{n}" for n in (done[-1:] if mode == "complete" else done)])


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in store.listStatus(at)] if store.exists(at) else []


def by_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """STR-03: calls a batch pipeline for each micro-batch of what there is; the step must bear to see a batch again."""
    with state.kept_by_rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
