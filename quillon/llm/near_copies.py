"""Links of near copies for the SimHash stage: MinHash bands propose pairs, exact sets decide.

A text is lower-cased (A-Z) and split as in simhash; its set are the hashes of its shingles of `words` words, of all its
words if they are fewer.  Texts with the same set are one node, so exact copies cost nothing.  Each node has BANDS bands of
ROWS minima; two sets of similarity s share no band with probability (1 - s^ROWS)^BANDS, 7e-5 at 0.8 and less above.

1. In each band the node with the least key leads, and the others are compared with it.  So in a group of copies of one text
   most nodes are linked after a comparison for each of their bands.  A node is named after its least leader that is similar.
2. In each band that still holds several names, nodes of different names are compared in blocks: parts of at most PART nodes
   or BYTES bytes, a task for each pair of parts.  Sketches (a byte of each minimum) leave out pairs whose estimated
   similarity is over four standard deviations below; the others are compared exactly, in the first band that they
   share, unless the block's links already join them.  A block returns links, never pairs.

Null text counts as empty.  Rows whose id is null are not compared.  An empty table gives no edges.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, scratch, written

#: Bands, and minima in each.
BANDS, ROWS = 24, 5
#: Nodes and bytes of a part of a band, at most (a larger set is a part of its own).
PART, BYTES = 2048, 16 << 20
#: Rows whose sets are held at once.
SLICE = 500
_SEEDS = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(defaultdict):
    """The 64-bit hashes of words, kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word, 42)
        if len(self) < 100_000:
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int, hashes: Hashes) -> np.ndarray:
    """The sorted set of hashes of the text's shingles."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(one))
    out = np.full(len(one) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _ODD + one[k : len(one) - n + 1 + k]
    return np.unique(mixed(out))


def bands(grams: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bands of a set, and its sketch."""
    if not len(grams):
        return np.zeros(0, np.int64), b""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(grams), 512):
        least = np.minimum(least, (grams[at : at + 512, None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out * _ODD + row)
    return out.view(np.int64), least.astype(np.uint8).tobytes()


def sets(docs: DataFrame, words: int, banded: bool) -> DataFrame:
    """docs: id, text.  id, key (names the set) and either its bands and its sketch or its hashes, eight bytes each."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashes = Hashes()
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):
            found = [shingles(t or b"", words, hashes) for t in batch.column(1).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(g.tobytes(), 42) for g in found], np.uint64).view(np.int64)
            if banded:
                both = [bands(g) for g in found]
                last = {"v": pa.array([x.tolist() for x, _ in both], pa.list_(pa.int64())), "sketch": pa.array([x for _, x in both], pa.binary())}
            else:
                last = {"v": pa.array([g.tobytes() for g in found], pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), *last.values()], ["id", "key", *last])

    kind = "v array<long>, sketch binary" if banded else "v binary"
    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, f"id long, key long, {kind}")


def similar(pairs: DataFrame, grams: DataFrame, fifths: int) -> DataFrame:
    """Those pairs (key, lead; each once) whose sets' similarity is `fifths` fifths or more."""

    def run(batches):
        for batch in batches:
            good = [alike(x, y, fifths) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(_array(good)).select([0, 1])

    leads = grams.join(pairs.groupBy("lead").agg(F.count("*").alias("n")), F.col("key") == F.col("lead")).select(F.col("lead").cast("string").alias("_lead"), F.col("v").alias("b"), "n")
    rows = lookup(pairs.withColumn("_lead", F.col("lead").cast("string")), leads, "_lead", "n", pairs.count(), "key")
    rows = rows.select("key", "lead", "b").join(grams.withColumnRenamed("v", "a"), "key").select("key", "lead", "a", "b")
    return rows.mapInArrow(run, "key long, lead long")


def _array(values: list[bool]):
    import pyarrow as pa

    return pa.array(values, pa.bool_())


def alike(x: bytes, y: bytes, fifths: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 5 * min(len(a), len(b)) < fifths * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= fifths * (len(a) + len(b) - both)


def block_links(band: int, keys: list, names: np.ndarray, sketches: np.ndarray, bands_: np.ndarray, grams: list, left: np.ndarray, fifths: int) -> list[tuple[int, int]]:
    """Links between nodes of different names that join what of a block is similar: of left rows with the others, or of all."""
    s, n = fifths / 5, sketches.shape[1]
    least = s * n - 4 * (n * s * (1 - s)) ** 0.5
    root, out = list(range(len(keys))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    rest = np.flatnonzero(~left)
    for a in np.flatnonzero(left).tolist() if len(rest) else range(len(keys)):
        others = rest if len(rest) else np.arange(a + 1, len(keys))
        others = others[names[others] != names[a]]
        others = others[(sketches[others] == sketches[a]).sum(axis=1) >= least]
        others = others[bands_[others, np.argmax(bands_[others] == bands_[a], axis=1)] == band]
        for b in others.tolist():
            x, y = find(a), find(b)
            if x != y and alike(grams[a], grams[b], fifths):
                root[max(x, y)] = min(x, y)
                out.append((keys[a], keys[b]))
    return out


def cross_links(live: DataFrame, nodes: DataFrame, grams: DataFrame, fifths: int) -> DataFrame:
    """Links (key, lead) within bands between nodes of different names; live: key, band, name."""
    weighed = live.join(grams.select("key", F.octet_length("v").alias("bytes")), "key")
    sizes = weighed.groupBy("band").agg(F.count("*").alias("size"), F.min("name").alias("a"), F.max("name").alias("z"), F.sum("bytes").alias("bytes"))
    sizes = sizes.filter("a <> z").select("band", "size", F.greatest(F.ceil(F.col("size") / PART), F.ceil(F.col("bytes") / BYTES)).cast("int").alias("parts"))
    rows = lookup(live, sizes, "band", "size", live.count(), "key").filter("size > 1")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", "name", F.col("band").cast("long").alias("band"), F.least("i", "j").alias("u"), F.greatest("i", "j").alias("w"), (F.col("i") <= F.col("j")).alias("left"))
    rows = rows.join(nodes.select("key", "sketch", F.col("v").alias("bands")), "key").join(grams, "key")

    def join(key, table):
        import pyarrow as pa

        band, u, w = (k.as_py() for k in key)
        left = np.array(table.column("left").to_pylist(), bool) if u != w else np.ones(len(table), bool)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)
        own = np.array(table.column("bands").to_pylist(), np.int64)
        found = block_links(band, table.column("key").to_pylist(), table.column("name").to_numpy(), sketches, own, table.column("v").to_pylist(), left, fifths)
        return pa.table({"key": pa.array([x for x, _ in found], pa.int64()), "lead": pa.array([y for _, y in found], pa.int64())})

    blocks = rows.select("key", "name", "band", "u", "w", "left", "sketch", "bands", "v")
    return blocks.groupBy("band", "u", "w").applyInArrow(join, "key long, lead long")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, fifths: int = 4) -> DataFrame:
    """Edges src, dst between rows of `docs` whose sets are equal or similar, which join all that are."""
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
        prints = keep(sets(rows, words, True), "near-rows")
        nodes = prints.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("sketch").alias("sketch"))
        nodes = keep(nodes, "near-nodes")
        own = lookup(prints.select("id", F.col("key").cast("string").alias("name")), nodes.select(F.col("key").cast("string").alias("name"), "rep", "n"), "name", "n", prints.count(), "id")
        edges = own.filter("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")).distinct()
        live = nodes.select("key", F.explode(F.col("v").cast("array<string>")).alias("band"))
        leads = live.groupBy("band").agg(F.count("*").alias("size"), F.min("key").alias("lead")).filter("size > 1")
        live = lookup(live, leads, "band", "size", BANDS * nodes.count(), "key").filter("size > 1")
        live = keep(live.select("key", "band", "lead"), "near-live")  # a band of one is of no use
        texts = rows.join(nodes.join(live.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        grams = sets(texts, words, False).select("key", "v").join(live.select("key").distinct(), "key", "left_semi")
        grams = keep(grams.dropDuplicates(["key"]), "near-grams")
        good = keep(similar(live.filter("key <> lead").select("key", "lead").distinct(), grams, fifths), "near-good")
        live = live.join(good.groupBy("key").agg(F.min("lead").alias("name")), "key", "left").select("key", "band", F.coalesce("name", "key").alias("name"))
        links = good.union(cross_links(keep(live, "near-named"), nodes, grams, fifths))
        rep = nodes.select("key", "rep")
        links = links.join(rep, "key").select("lead", F.col("rep").alias("src")).join(rep.withColumnRenamed("key", "lead"), "lead").select("src", F.col("rep").alias("dst"))
        return written(edges.union(links.filter("src <> dst")).distinct(), "near-links")
