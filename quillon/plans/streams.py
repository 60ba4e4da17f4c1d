"""Queries of the streaming layer; each drains its source and gives the sink's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard
from ..sources import tables as t
from ..sources.shared import new_path
from ..streaming import jobs, state
from .catalogue import query


def place(spark) -> str:
    """A new checkpoint folder, in the folder that driver and executors share."""
    return new_path(spark, "stream")


def source(spark, d):
    return jobs.events(spark, d)


@query("stream_daily_window", "SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def stream_daily_window(spark, d):
    return jobs.run(jobs.daily_windows(source(spark, d)), "complete", place(spark))


@query("stream_sliding_fail_rate", """SELECT CAST(day AS DATE) AS first_day, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM (SELECT event_type, unnest(generate_series(CAST(ts AS DATE) - 6, CAST(ts AS DATE), INTERVAL 1 DAY)) AS day FROM events) GROUP BY 1""")
def stream_sliding_fail_rate(spark, d):
    return jobs.run(jobs.sliding_failures(source(spark, d)), "complete", place(spark))


@query("stream_session_users", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first_one FROM events),
 s AS (SELECT *, sum(first_one) OVER (PARTITION BY user_id ORDER BY ts, first_one DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session_users(spark, d):
    return jobs.run(jobs.sessions(source(spark, d)), "complete", place(spark))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    rows = jobs.deduplicated(source(spark, d), ["user_id", "event_type"], "3650 days")
    return jobs.run(rows, "append", place(spark)).select("user_id", "event_type")


@query("stream_ingest_filesource")
def stream_ingest_filesource(spark, d):
    """STR-01: the document files as a stream, each new text once, with its status."""
    schema = t.table(spark, d, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*")
    fresh = docs.withColumn("file_hash", F.sha2("text", 256)).dropDuplicates(["file_hash"])
    return jobs.run(fresh.select("file_hash", "lang", F.lit("need_review").alias("status")), "append", place(spark))


@query("stream_recon_foreach_batch", "SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, min(ts) AS started_at, max(ts) AS finished_at FROM events GROUP BY 1")
def stream_recon_foreach_batch(spark, d):
    """STR-03: each micro-batch goes through the batch pipeline, keyed by its number so that a repeated batch overwrites itself."""
    out = place(spark)

    def step(batch, number):
        rows = batch.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("result"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
        dashboard.job_counters(rows).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    jobs.by_batch(source(spark, d), step, f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("job_id").agg(F.sum("total").alias("total"), F.sum("success").alias("success"), F.sum("failed").alias("failed"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))


@query("stream_once", "SELECT DISTINCT user_id, props FROM events")
def stream_once(spark, d):
    """STR-02: users and what they sent, each once, with the ids that came before as state."""
    rows = source(spark, d).select("user_id", "props")
    return jobs.run(state.once(rows, "user_id", ["props"]), "append", place(spark))


@query("stream_breaker", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'view') AS bad, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, event_id, k, ms, bad, CASE WHEN bad THEN 1 ELSE 0 END AS failures, CAST(0 AS BIGINT) AS until, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS outcome FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, e.ms, e.bad,
   CASE WHEN r.failures >= 3 AND e.ms < r.until THEN r.failures WHEN NOT e.bad THEN 0 WHEN r.failures >= 3 THEN 1 ELSE r.failures + 1 END,
   CASE WHEN r.failures = 2 AND e.bad THEN e.ms + 43200000 ELSE r.until END,
   CASE WHEN r.failures >= 3 AND e.ms < r.until THEN 'refused' WHEN e.bad THEN 'failed' ELSE 'ok' END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
 SELECT CAST(user_id AS VARCHAR) AS provider, event_id AS call, ms, outcome FROM r
 UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, ms + 43200000, 'closed' FROM r WHERE failures = 3 AND outcome = 'failed' AND ms + 43200000 <= (SELECT max(epoch_us(ts) // 1000) - 60000 FROM events)""")
def stream_breaker(spark, d):
    """STR-04: each user's calls through a breaker that opens for twelve hours; errors and views count as failures."""
    calls = source(spark, d).select(F.col("user_id").alias("provider"), F.col("event_id").alias("call"), F.col("ts").alias("at"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    rows = jobs.run(state.guarded(calls, wait=12 * 3_600_000), "append", place(spark))
    return rows.select("provider", "call", F.unix_millis("at").alias("ms"), "outcome")
