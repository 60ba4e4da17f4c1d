"""What the operators of this subpackage share: the shared folder, written tables, skew-safe lookups."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove, scratch, written  # noqa: F401

#: A key is heavy if it holds at least this fraction of all rows, so there are at most 1 / HEAVY of them.
HEAVY = 1 / 5000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  lower() does the same, and faster, unless other characters have a lower case too."""
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(others) == others, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def lookup(big: DataFrame, small: DataFrame, key: str, count: str, total: int, row_id: str) -> DataFrame:
    """Left join of `big` with `small`, whose `key` is unique, and which is safe against hot keys.

    `count` is the number of rows of `big` that have the key, `total` that of all its rows.  Keys that
    hold a fraction HEAVY of all rows are at most 1 / HEAVY and are broadcast; the others are shuffled,
    while the rows of heavy keys are dealt out by `row_id`.  Columns of `big` keep their names, whatever they are;
    those of the same name as a value of `small` give way.
    """
    values = [c for c in small.columns if c != key]
    kept = [c for c in big.columns if c not in values]
    name = f"lookup-{'-'.join(kept)}-"  # longer than any column's name

    def of(df: DataFrame, *own: str) -> DataFrame:
        return df.toDF(*[f"{name}{o}" for o in own])

    hot, hot_value, dealt, light_key, light_value = (f"{name}{x}" for x in ("hot", "hot-value", "dealt", "key", "value"))
    least = max(2, int(total * HEAVY))
    packed = small.select(F.col(f"`{key}`").cast("string").alias("k"), F.struct(*[F.col(f"`{c}`") for c in values]).alias("v"), (F.col(f"`{count}`") >= least).alias("h"))
    heavy, light = of(packed.filter("h").select("k", "v"), "hot", "hot-value"), of(packed.filter("NOT h").select("k", "v"), "key", "value")
    own = F.col(f"`{key}`").cast("string")
    big = big.join(F.broadcast(heavy), own == F.col(f"`{hot}`"), "left")
    # A heavy row gets a number instead of its key, marked so that it meets no key.
    number = F.when(F.col(f"`{row_id}`").isNotNull(), F.xxhash64(F.col(f"`{row_id}`"))).otherwise(F.monotonically_increasing_id())
    spread = F.concat(F.lit("#\x00"), number.cast("string"))
    big = big.withColumn(dealt, F.when(F.col(f"`{hot}`").isNull() & own.isNotNull(), own).otherwise(spread))
    big = big.join(light, F.col(f"`{dealt}`") == F.col(f"`{light_key}`"), "left")
    value = F.coalesce(F.col(f"`{hot_value}`"), F.col(f"`{light_value}`"))
    return big.select(*[F.col(f"`{c}`") for c in kept], *[value.getField(c).alias(c) for c in values])
