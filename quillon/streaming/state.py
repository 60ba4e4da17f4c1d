"""Stateful operators of streams (STR-02, STR-04): ids that were processed before, and circuit breakers, one state for each key.

State is kept by Spark in its state store, with the stream's checkpoint, so it survives restarts and lost executors.  These operators
need the RocksDB state store; kept_by_rocksdb() sets it while a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def kept_by_rocksdb(spark: SparkSession):
    """Queries that start within keep their state in RocksDB; the setting is the old one afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Once(StatefulProcessor):
    """The first row of each id of a group.  A group's ids are read once for each batch in which it has rows; an id is forgotten, and
    may come again, after `keep` milliseconds, unless that is 0."""

    def __init__(self, ids: list[str], schema: str, keep: int):
        self.ids, self.schema, self.keep = ids, schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", self.schema, **({"ttlDurationMs": self.keep} if self.keep else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, new = set(self.seen.get()), []
        for part in rows:
            first = []
            for own in part[self.ids].itertuples(index=False, name=None):
                own = tuple(None if pd.isna(v) else v for v in own)
                first.append(own not in known)
                if first[-1]:
                    known.add(own)
                    new.append(own)
            yield part[first]
        if new:
            self.seen.appendList(new)

    def close(self) -> None:
        pass


def once(stream: DataFrame, group: str, ids: list[str], keep: int = 0) -> DataFrame:
    """STR-02: one row for each id of a group (the mails of a mailbox), whenever it came; `keep` is how long ids are remembered, in
    milliseconds (0: for good).  A group's ids must fit in a task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*ids).schema)
    return stream.groupBy(group).transformWithStateInPandas(Once(ids, schema, keep), stream.schema, "append", "processingTime" if keep else "none")


CALLS = "provider string, call long, at timestamp, outcome string"


class Breaker(StatefulProcessor):
    """After `most` failures in a row calls are refused for `wait` milliseconds.  A refused call counts for nothing.  A timer at the
    end of that time gives a row `closed`; the first call after it starts from nothing."""

    def __init__(self, most: int, wait: int):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", "call"])
        failures, until = self.state.get() if self.state.exists() else (0, 0)
        outcomes = []
        for at, ok in zip(calls["at"], calls["ok"], strict=True):
            now = at.value // 1_000_000
            if failures >= self.most and now < until:
                outcomes.append("refused")
                continue
            failures = 0 if failures >= self.most else failures
            failures = 0 if ok else failures + 1
            outcomes.append("ok" if ok else "failed")
            if failures >= self.most:
                until = now + self.wait
                self.handle.registerTimer(until)
        self.state.update((failures, until))
        yield pd.DataFrame({"provider": key[0], "call": calls["call"].to_numpy(), "at": calls["at"].to_numpy(), "outcome": outcomes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame({"provider": [key[0]], "call": pd.array([None], "Int64"), "at": [at], "outcome": ["closed"]})

    def close(self) -> None:
        pass


def guarded(calls: DataFrame, most: int = 3, wait: int = 60_000, late: str = "1 minute") -> DataFrame:
    """STR-04: calls (provider, call, at, ok) with their outcome: ok, failed or refused, and a row for each time that a breaker closes.  A
    provider's calls count in the order of their times within a batch; those later than the watermark are dropped."""
    rows = calls.select(F.col("provider").cast("string").alias("provider"), F.col("call").cast("long").alias("call"), F.col("at").cast("timestamp").alias("at"), "ok")
    return rows.withWatermark("at", late).groupBy("provider").transformWithStateInPandas(Breaker(most, wait), CALLS, "append", "eventTime")
