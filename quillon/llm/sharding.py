"""Sharding by a minimax contiguous partition of groups of equal texts.

Groups of documents with equal texts are atoms, ordered by their smallest id.  The order is cut into at most the given
number of runs.  A group larger than the capacity can't be divided and is a run of its own; the smallest capacity for which
cutting greedily needs no more than the given runs is found by binary search.  So the largest run is as small as in any
contiguous partition (the largest group, or the capacity), and beside a huge group the others are still divided as
evenly as the order allows.  Greedy cuts leave the last run short; so each cut is moved back towards an even share of
what is left, as far as the rest then still fits.

No list of all groups meets in one place.  The driver holds segments: runs of the order with sum, largest
group and number of groups.  A greedy check that takes segments of several groups whole bounds the capacity and each
cut from one side, one that splits them at will from the other.  Segments that are large for a run, or in which a cut can
still fall, are cut finer by an aggregation that returns at most REFINE rows for each, until no cut can fall within
a segment; then the search is exact.

A shard's slots are the ranks of its rows by group and id: rows are range-partitioned, and the ranks before
each partition's part of a shard come from one count for each.

Sizes are the UTF-8 bytes of a text plus `overhead`.  Null text counts as empty.  Null ids sort first; repeated
rows are of one group.  Columns besides id and text are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, written

SEGMENTS, REFINE = 4096, 64
#: A segment of several groups is no more than the capacity over FINE.
FINE = 64
PART = 33  # bits of a row's number within its partition, in monotonically_increasing_id()


class Segments:
    """Runs of the ordered groups: first (order number), sum, largest, n and width (order numbers they may span)."""

    def __init__(self, rows: np.ndarray, shards: int):
        self.rows, self.shards = rows[np.argsort(rows[:, 0])], shards
        self.first, self.sum, self.largest, self.n, self.width = self.rows.T
        self.ends = np.concatenate([[0], np.cumsum(self.sum)])
        self.total = int(self.ends[-1])

    def alone(self, capacity: int) -> np.ndarray:
        """The segments that are one group over the capacity, and one beyond the last segment."""
        return np.append(np.flatnonzero((self.n == 1) & (self.sum > capacity)), len(self.n))

    def reach(self, at: int, capacity: int, alone: np.ndarray) -> int:
        """The segment before which a run must end that starts at a segment."""
        k = int(alone[np.searchsorted(alone, at)])
        if k == at:
            return min(at + 1, len(self.n))
        return min(k, int(np.searchsorted(self.ends, self.ends[at] + capacity, "right")) - 1)

    def whole(self, capacity: int) -> list[int]:
        """The segments before each cut if each run takes all whole segments that fit."""
        cuts, alone = [0], self.alone(capacity)
        for _ in range(self.shards):
            cuts.append(self.reach(cuts[-1], capacity, alone))
        return cuts

    def split(self, capacity: int) -> list[int]:
        """Sizes before each cut if segments of several groups can be split anywhere, single groups not at all."""
        cuts, at, alone = [0], 0, self.alone(capacity)
        for _ in range(self.shards):
            k = int(np.searchsorted(self.ends, at, "right")) - 1  # the segment that starts at or spans this place
            next_ = int(alone[np.searchsorted(alone, k)])
            if next_ == k < len(self.n):
                at = int(self.ends[k + 1])
            else:
                at = min(at + capacity, int(self.ends[next_]))
                k = int(np.searchsorted(self.ends, at, "right")) - 1
                if k < len(self.n) and self.n[k] == 1:
                    at = int(self.ends[k])
            cuts.append(at)
        return cuts

    def least(self, low: int, fits) -> int:
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid) else (mid + 1, high)
        return low

    def solve(self) -> tuple[int, np.ndarray]:
        """The capacity, and the segments that must be cut finer before it is exact."""
        low = self.least(1, lambda c: self.split(c)[-1] == self.total)
        coarse = (self.n > 1) & (self.sum > max(1, low // FINE)) & (self.width > 1)
        if coarse.any():
            return low, coarse
        high = self.least(low, lambda c: self.whole(c)[-1] == len(self.n))
        early, late = self.ends[self.whole(low)], np.array(self.split(high))
        unclear = np.zeros(len(self.n), bool)
        for a, b in zip(early[1:], late[1:], strict=True):
            unclear |= (self.ends[1:] > a) & (self.ends[:-1] < b) & (self.n > 1)
        return high, unclear

    def spread(self, capacity: int) -> list[int]:
        """The segments before each cut: as near to an even share of what is left as the capacity allows."""
        n, alone = len(self.n), self.alone(capacity)
        back = Segments(np.column_stack([-self.first, self.sum, self.largest, self.n, self.width]), self.shards)
        least = [n - k for k in back.whole(capacity)][::-1]  # before cut k at least so many, so that the rest fits
        cuts = [0]
        for k in range(1, self.shards):
            at, far = cuts[-1], self.reach(cuts[-1], capacity, alone)
            even = self.ends[at] + (self.total - self.ends[at]) / (self.shards - k + 1)
            near = int(np.searchsorted(self.ends, even))
            if near > at + 1 and even - self.ends[near - 1] < self.ends[min(near, n)] - even:
                near -= 1
            cuts.append(min(far, max(near, least[k], min(at + 1, n))))
        return cuts


def cut_points(ordered: DataFrame, shards: int) -> list[int]:
    """The first order number of each shard; ordered: order, size."""
    number, part = F.col("order").bitwiseAND((1 << PART) - 1), F.shiftright("order", PART)

    def runs(rows: DataFrame, width: int) -> np.ndarray:
        at = F.shiftleft(part, PART) + number - F.pmod(number, F.lit(width))
        found = rows.groupBy(at.alias("first")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n")).collect()
        return np.array([(r.first, r.s, r.m, r.n, width) for r in found], np.int64).reshape(-1, 5)

    n = ordered.count()
    if not n:
        return []
    segments = Segments(runs(ordered, 1 << max(0, math.ceil(math.log2(n / SEGMENTS)))), shards)
    while True:
        capacity, unclear = segments.solve()
        if not unclear.any():
            break
        rows = [segments.rows[~unclear]]
        for width in np.unique(segments.width[unclear]).tolist():
            firsts = segments.first[unclear & (segments.width == width)].tolist()
            asked = ordered.sparkSession.createDataFrame([(f,) for f in firsts], "asked long")
            own = F.col("order") - F.pmod(number, F.lit(width))
            part_rows = ordered.join(F.broadcast(asked), own == F.col("asked"), "left_semi")
            rows.append(runs(part_rows, max(1, width // REFINE)))
        segments = Segments(np.concatenate(rows), shards)
    cuts = segments.spread(capacity)
    return [int(segments.first[c]) for c in dict.fromkeys(cuts) if c < len(segments.first)]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each row of `docs`: its id, size, text_crc32, shard (0 to shards - 1) and slot (from 0, without gaps)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            id_col,
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(id_col).alias("least"))
    in_order = groups.repartitionByRange("least", "digest").sortWithinPartitions("least", "digest")
    groups = written(in_order.select("digest", "size", "n", F.monotonically_increasing_id().alias("order")), "shard-groups")
    cuts = cut_points(groups.select("order", "size"), shards)
    own = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("order"))) - 1 if cuts else F.lit(0)
    shard_of = own.cast("int")
    sharded = groups.select("digest", "n", "order", shard_of.alias("shard"))
    placed = lookup(rows, sharded, "digest", "n", rows.count(), id_col).select(id_col, "size", "text_crc32", "shard", "order")
    placed = placed.repartitionByRange("shard", "order", id_col).sortWithinPartitions("shard", "order", id_col)
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "shard-placed")
    here = F.shiftright("row", PART).alias("part")
    parts = placed.groupBy("shard", here).agg(F.min("row").alias("first"), F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")
    parts = parts.select("shard", "part", (before - F.col("first")).alias("shift"))  # a row for each partition and shard in it
    return (
        placed.withColumn("part", here)
        .join(F.broadcast(parts), ["shard", "part"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
