"""Streams over files that come one after another: restarts, late rows, processed ids, breakers."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillon.streaming import jobs, state

SCHEMA = "user_id long, ts timestamp, event_type string, event_id long"
DAY = datetime.datetime(2026, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


@pytest.fixture
def folder(spark, tmp_path):
    """put(rows) adds a file; stream() reads them in the order in which they came, one to a batch."""

    class Folder:
        n = 0

        def put(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{self.n:03d}")
            self.n += 1

        def stream(self):
            return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")

        work = f"file://{tmp_path}/work"

    return Folder()


def test_late_rows_are_dropped(folder):
    """A row that is later than the watermark of two days counts no more; one within it does, also after a restart."""
    folder.put([(1, at(0), "a", 1), (1, at(60 * 24 * 5), "error", 2)])
    jobs.run(jobs.daily_windows(folder.stream()), "append", folder.work)
    folder.put([(1, at(1), "late", 3), (1, at(60 * 24 * 4), "a", 4)])
    folder.put([(1, at(60 * 24 * 20), "a", 5)])
    got = jobs.run(jobs.daily_windows(folder.stream()), "append", folder.work)
    assert sorted((str(r.day), r.total, r.failed) for r in got.collect()) == [("2026-01-01", 1, 0), ("2026-01-05", 1, 0), ("2026-01-06", 1, 1)]


def test_runs_go_on_where_the_last_one_ended(folder):
    folder.put([(1, at(0), "a", 1)])
    once = lambda: sorted(r.event_id for r in jobs.run(state.once(folder.stream(), "user_id", ["event_type"]), "append", folder.work).collect())
    assert once() == [1] and once() == [1]
    folder.put([(1, at(1), "a", 2), (1, at(1), "b", 3), (1, at(2), "b", 4), (2, at(1), "a", 5), (1, at(1), None, 6), (1, at(1), None, 7)])
    folder.put([(2, at(1), "a", 8)])
    got = once()
    assert len(got) == 4 and got[0] == 1 and 8 not in got and len({3, 4} & set(got)) == len({6, 7} & set(got)) == 1 and 5 in got


def test_streams_without_rows(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder.work.removeprefix('file://')}/../in/none")
    got = jobs.run(jobs.daily_windows(folder.stream()), "append", folder.work)
    assert got.columns == ["day", "total", "failed"] and got.count() == 0


def test_breaker(folder):
    """Open after three failures in a row, for ten minutes; refused calls count for nothing; state goes from batch to batch."""
    calls = lambda: folder.stream().select(F.col("user_id").alias("provider"), F.col("event_id").alias("call"), F.col("ts").alias("at"), (F.col("event_type") == "ok").alias("ok"))
    run = lambda: jobs.run(state.guarded(calls(), wait=600_000), "append", folder.work)
    folder.put([(1, at(2), "bad", 3), (1, at(0), "bad", 1), (1, at(1), "ok", 2), (2, at(0), "bad", 50)])
    run()
    folder.put([(1, at(3), "bad", 4), (1, at(4), "bad", 5), (1, at(5), "ok", 6), (1, at(13.9), "bad", 7)])
    run()
    folder.put([(1, at(14), "bad", 8), (1, at(15), "bad", 9), (1, at(16), "bad", 10), (1, at(17), "ok", 11), (2, at(40), "ok", 51)])
    got = {r.call: r.outcome for r in run().filter("call IS NOT NULL").collect()}
    assert got == {1: "failed", 2: "ok", 3: "failed", 4: "failed", 5: "failed", 6: "refused", 7: "refused", 8: "failed", 9: "failed", 10: "failed", 11: "refused", 50: "failed", 51: "ok"}
    closed = sorted((r.provider, r.at) for r in run().filter("outcome = 'closed'").collect())
    assert closed == [("1", at(14)), ("1", at(26))]
