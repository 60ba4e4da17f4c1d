"""Joins and ranks that a hot key can't make uneven."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: A key is heavy if it holds at least this fraction of all rows, so there are at most 1 / HEAVY of them.
HEAVY = 1 / 5000
#: Bits of a row's number within its partition, in monotonically_increasing_id().
PART = 33


def group_counts(rows: DataFrame, key: str, row_id: str, open_: Column) -> DataFrame:
    """rows with _n, the number of rows of the same `key` for which `open_` holds.  Counts are partial aggregates; those of heavy
    keys are broadcast, while rows of heavy keys are dealt out by `row_id`, so no key's rows meet in one task."""
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count_if(open_).alias("_n"), F.count("*").alias("_all"))
    least = max(2, int(rows.count() * HEAVY))
    heavy = counts.filter(F.col("_all") >= least).select(F.col("_key").alias("_hot"), F.col("_n").alias("_hot_n"))
    light = counts.filter(F.col("_all") < least).drop("_all")
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "left")
    dealt = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("#\x00"), F.xxhash64(row_id).cast("string")))
    out = out.withColumn("_dealt", dealt).join(light, F.col("_dealt") == F.col("_key"), "left")
    return out.withColumn("_n", F.coalesce("_hot_n", "_n", F.lit(0))).drop("_hot", "_hot_n", "_key", "_dealt")


def ranked(rows: DataFrame, group: list[str], order: list[str | Column], name: str, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """rows with the place (from 0) of each within its group; `keep` writes them.  Rows are range-partitioned by group and order, so a large group
    spans partitions; what stands before a partition's part of a group is a count for each such part."""
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = keep(placed.withColumn("_row", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_row", PART))
    parts = placed.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_size")  # a row for each part of a group
    parts = parts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = placed.join(parts, same).withColumn(name, F.col("_row") + F.col("_shift"))
    return out.select(*rows.columns, name)
