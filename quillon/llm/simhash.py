"""SimHash near-duplicates by a self-join of a binary trie.

A text is lower-cased (A-Z), split at [\\x20\\x09-\\x0D] and cut into shingles of `words` words; each bit of
its fingerprint is the majority of that bit in the XXH64 (seed 42) of its shingles.  Fewer words make one
shingle, none the fingerprint zero.  Fingerprints that differ in `limit` bits or fewer are linked, and
documents with linked or equal fingerprints are of one component, named by its smallest id.

The join runs over distinct fingerprints, so exact copies cost nothing.  The trie orders bits by how evenly
they split the fingerprints, the most even first.  Its upper `depth` levels deal the work out: the node of
each fingerprint meets the nodes whose prefixes differ in `limit` bits or fewer, a block for each pair of
nodes.  Nodes with more than NODE fingerprints are cut into parts, and pairs of parts make the blocks, so no
block holds more than a few NODE of them.  Within a block, trie_pairs() walks down both nodes together, adds up
the bits in which they differ and prunes pairs over the limit.  Each block returns a spanning forest of its
links, and alternating large-star and small-star rounds join the forests; every round is a table in the
shared folder.

Null text counts as empty.  A null id counts as larger than all others.  Repeated rows are copies of one
another.  Columns besides id and text are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, new_path, remove, written

#: Fingerprints of a node of the dealing levels, roughly, and the number of these levels at least and at most: each
#: fingerprint goes to as many blocks as there are nodes near its own (16 for 5 levels, growing as their square).
NODE, LEVELS = 1 << 16, (5, 20)
LAST = 9223372036854775807


def fingerprint(text: bytes, words: int = 3) -> int:
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    words = min(words, len(parts))
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(parts) - words + 1], ends[words - 1 :]
    one, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 14):
        cut = slice(at, at + (1 << 14))
        h = np.array([one(joined[a:b], 42) for a, b in zip(starts[cut].tolist(), ends[cut].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The id and the fingerprint, a signed 64-bit integer, of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t or b"", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, bits long")


def trie_pairs(a: np.ndarray, b: np.ndarray, same: bool, limit: int, leaf: int = 48, most: int = 1 << 17):
    """Yields arrays of positions in the sorted a and b whose values differ in `limit` bits or fewer; with
    `same`, a is b and each pair comes once.  A node is a range of positions; the pairs of nodes of one level are
    arrays, cut into pieces of `most` that wait on a stack, so memory doesn't grow with the number of pairs."""
    if not len(a) or not len(b):
        return
    start = np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64)
    stack = [(0, start)]
    while stack:
        depth, pairs = stack.pop()
        a0, a1, b0, b1, diff = pairs
        small = (a1 - a0) * (b1 - b0) <= leaf if depth < 64 else np.ones(len(a0), bool)
        if small.any():
            yield from leaf_pairs(a, b, same, limit, pairs[:, small])
            pairs = pairs[:, ~small]
            a0, a1, b0, b1, diff = pairs
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - depth)) & 0xFFFFFFFFFFFFFFFF)
        am = np.searchsorted(a, (a[a0] & above) | bit)
        bm = np.searchsorted(b, (b[b0] & above) | bit)
        nexts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am, a1, b0, bm, diff + 1)]
        if same:  # of a node with itself, the mixed pair counts once
            own = a0 == b0
            nexts[3] = tuple(x[~own] for x in nexts[3])
        below = np.concatenate([np.stack(x) for x in nexts], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= limit)]
        stack += [(depth + 1, below[:, k : k + most]) for k in range(0, below.shape[1], most)]


def leaf_pairs(a, b, same, limit, pairs, most: int = 1 << 20):
    a0, a1, b0, b1, _ = pairs
    wide = b1 - b0
    count = (a1 - a0) * wide
    ends = np.cumsum(count)
    first = 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most)))
        cut = slice(first, last)
        n = count[cut]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(wide[cut], n)
        i, j = np.repeat(a0[cut], n) + k // w, np.repeat(b0[cut], n) + k % w
        near = np.bitwise_count(a[i] ^ b[j]) <= limit
        if same:
            near &= i < j
        yield i[near], j[near]
        first = last


def forest(n: int, pairs) -> np.ndarray:
    """For each of n positions the smallest position that it is linked to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def links(distinct: DataFrame, limit: int, n: int) -> DataFrame:
    """Edges src, dst (dst the smaller) that join all reps of linked fingerprints; distinct: bits, rep."""
    even = distinct.agg(*[F.sum(F.shiftright("bits", k).bitwiseAND(1)).alias(f"b{k}") for k in range(64)]).first()
    order = sorted(range(64), key=lambda k: abs(even[k] / n - 0.5))
    depth = min(LEVELS[1], max(LEVELS[0], math.ceil(math.log2(n / NODE))))
    masks = [0, *(1 << i for i in range(depth))]
    if limit >= 2:
        masks += [1 << i | 1 << j for i in range(depth) for j in range(i)]
    if limit > 2:
        raise ValueError("limits over 2 bits are not supported")

    def permuted(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for k, bit in enumerate(order):
            out |= (x >> np.uint64(bit) & np.uint64(1)) << np.uint64(63 - k)
        return out

    def prefix(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(x), np.int64)

    def prefixes(batches):
        import pyarrow as pa

        for batch in batches:
            found, count = np.unique(prefix(permuted(batch.column(0).to_numpy().view(np.uint64))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count)], ["node", "n"])

    sizes = distinct.select("bits").mapInArrow(prefixes, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    parts = {r.node: math.ceil(r.n / NODE) for r in sizes.filter(F.col("n") > 2 * NODE).collect()}  # n / (2 * NODE) rows at most

    def part(x: np.ndarray, k: int) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % k

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            x, rep = permuted(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy()
            u = prefix(x)
            i = np.zeros(len(x), np.int64)
            for node, k in parts.items():
                i[u == node] = part(x[u == node], k)
            for mask in masks:
                v = u ^ mask
                many = np.ones(len(x), np.int64)
                for node, k in parts.items():
                    many[v == node] = k
                at = np.repeat(np.arange(len(x)), many)
                j = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                uu, vv, ii = u[at], v[at], i[at]
                swap = (uu > vv) | ((uu == vv) & (ii > j))
                cols = [np.where(swap, vv, uu), np.where(swap, uu, vv), np.where(swap, j, ii), np.where(swap, ii, j)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(x.view(np.int64)[at]), pa.array(rep[at])], ["u", "v", "i", "j", "bits", "rep"])

    def join(key, table):
        import pyarrow as pa

        u, v, i, j = (k.as_py() for k in key)
        x, rep = table.column("bits").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        order = np.argsort(x)
        x, rep = x[order], rep[order]
        if (u, i) == (v, j):
            root = forest(len(x), trie_pairs(x, x, True, limit))
        else:
            left = prefix(x) == u if u != v else part(x, parts[u]) == i
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            root = forest(len(x), ((a[p], b[q]) for p, q in trie_pairs(x[a], x[b], False, limit)))
        least = np.full(len(x), LAST)
        np.minimum.at(least, root, rep)
        dst = least[root]
        apart = rep != dst
        return pa.table({"src": rep[apart], "dst": dst[apart]})

    blocks = distinct.select("bits", "rep").mapInArrow(deal, "u long, v long, i long, j long, bits long, rep long")
    return blocks.groupBy("u", "v", "i", "j").applyInArrow(join, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of the edges (src, dst).  A node's least neighbour is an aggregate
    that is looked up again, so that the node with the most neighbours is no task of its own."""
    spark = edges.sparkSession
    before, path = None, new_path(spark, "edges")
    edges.select("src", "dst").write.parquet(path)

    def with_least(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("degree"))
        return lookup(rows, least, "src", "degree", rows.count(), "dst")

    while True:
        edges = spark.read.schema("src long, dst long").parquet(path)
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = with_least(both).withColumn("m", F.least("src", "m")).filter("dst > src")
        large_path = new_path(spark, "edges")
        large.select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct().write.parquet(large_path)
        small = with_least(spark.read.schema("src long, dst long").parquet(large_path))
        small = small.select("src", F.col("m").alias("dst")).union(
            small.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        )
        old, path = path, new_path(spark, "edges")
        small.distinct().write.parquet(path)
        remove(spark, old)
        remove(spark, large_path)
        now = spark.read.schema("src long, dst long").parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        before = state


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 2
) -> DataFrame:
    """One row for each row of `docs`: its id, fingerprint (16 hex digits) and component_id."""
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    distinct = written(rows.groupBy("bits").agg(F.min(own).alias("rep"), F.count("*").alias("copies")), "simhash-bits")
    total, n = rows.count(), distinct.count()
    hexa = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    classes = distinct.select(hexa, F.col("rep").alias("component"), "copies")
    if n > 1:
        found = components(links(distinct, limit, n))
        classes = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
            hexa, F.coalesce("component", "rep").alias("component"), "copies"
        )
    labelled = lookup(rows.select(id_col, hexa), classes, "fingerprint", "copies", total, id_col)
    return labelled.select(id_col, "fingerprint", F.nullif("component", F.lit(LAST)).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
