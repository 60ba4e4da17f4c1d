"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session without it a new temporary folder; elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives any executor."""
    return written_to(df, new_path(df.sparkSession, name))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Within it, the files of a query's shuffles go when it ends, instead of when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written_to(df: DataFrame, path: str, **options: int | str) -> DataFrame:
    with swept(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() or the like has made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """A written() whose tables can be deleted one by one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, {}

    def __call__(self, df: DataFrame, name: str, **options: int | str) -> DataFrame:
        path = new_path(self.spark, name)
        self.made[path] = None  # so that a write that fails is deleted as well
        self.made[path] = written_to(df, path, **options)
        return self.made[path]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for path in [p for p, df in self.made.items() if any(df is t for t in tables)]:
            remove(self.spark, path)
            del self.made[path]


@contextmanager
def scratch(spark: SparkSession):
    """Gives a written() whose tables are deleted at the end; what is returned from within must be written otherwise."""
    own = Scratch(spark)
    try:
        yield own
    finally:
        for path in own.made:
            remove(spark, path)
