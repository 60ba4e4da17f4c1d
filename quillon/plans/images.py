"""Queries of pictures, drawn from the embeddings' numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pictures
from ..operators import sinks
from ..sources import pictures as source
from ..sources import tables as t
from ..sources.shared import new_path
from .catalogue import query


@F.pandas_udf(T.BinaryType())
def tiles(values: pd.Series) -> pd.Series:
    """A grey picture of 9 x 8 pixels from 64 numbers: 128 at the left of each row."""

    def one(v) -> bytes:
        rows = np.full((8, 9), 128, np.uint8)
        rows[:, 1:] = np.clip(np.floor(np.asarray(v, np.float32).astype(np.float64) * 200) + 128, 0, 255).reshape(8, 8)
        return source.png(9, 8, 1, rows.tobytes())

    return values.map(one)


@F.pandas_udf(T.BinaryType())
def page(key: pd.Series) -> pd.Series:
    """A page with a red ring, a red line, nothing, or a grey ring, by the key's remainder; the places follow the key."""

    def one(k: int) -> bytes:
        out = np.full((160, 120, 3), 255, np.uint8)
        y, x = np.mgrid[:160, :120]
        far = np.hypot(y - 60 - k % 40, x - 50 - k % 20)
        ring = (far <= 25) & (far >= 18)
        if k % 4 == 0:
            out[ring] = (200, 40, 40)
        elif k % 4 == 1:
            out[20 + k % 50 : 26 + k % 50, 10:110] = (200, 40, 40)
        elif k % 4 == 3:
            out[ring] = (120, 120, 120)
        return source.png(120, 160, 3, out.tobytes())

    return key.map(one)


def archive(spark, rows, content, what):
    folder = new_path(spark, "pictures")
    sinks.archived(rows.select(F.col("vec_id").alias("id"), content.alias("content")), folder, F.concat(F.lit("p"), (F.col("id") % 7).cast("string")), F.concat(F.col("id").cast("string"), F.lit(".png")), F.col("content"))
    return source.scanned(spark, folder, lambda found: what(found.withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))))


@query("picture_hashes", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda e: least(255, greatest(0, floor(CAST(e AS DOUBLE) * 200) + 128))) AS v FROM embeddings),
 b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN CASE WHEN (i - 1) % 8 = 0 THEN 128 ELSE v[i - 1] END < v[i] THEN 1 ELSE 0 END) AS bits FROM p)
 SELECT vec_id, 9 AS width, 8 AS height, 'L' AS mode, array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', 1 + 8 * bits[4 * k + 1] + 4 * bits[4 * k + 2] + 2 * bits[4 * k + 3] + bits[4 * k + 4], 1)), '') AS phash FROM b""")
def picture_hashes(spark, d):
    """SRC-04, FN-72: pictures written as PNG files, read by Spark's image source."""
    hashed = lambda rows: rows.select("vec_id", "width", "height", "mode", pictures.dhash("picture").alias("phash"))
    return archive(spark, t.table(spark, d, "embeddings"), tiles("embedding"), hashed)


@query("seal_status", "SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'sealed' WHEN 1 THEN 'unsealed' ELSE 'suspect' END AS status, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN vec_id % 4 = 0 THEN 60 + vec_id % 40 END AS cy, CASE WHEN vec_id % 4 = 0 THEN 50 + vec_id % 20 END AS cx FROM embeddings")
def seal_status(spark, d):
    """FN-74, FN-77: pages with and without seals; a seal's middle is where it was drawn."""
    rows = archive(spark, t.table(spark, d, "embeddings"), page("vec_id"), lambda found: found.select("vec_id", pictures.seal("picture").alias("s")))
    middle = lambda c: F.floor(F.get("s.seals", F.lit(0))[c]).cast("long").alias(c)
    return rows.select("vec_id", "s.status", "s.n", middle("cy"), middle("cx"))
