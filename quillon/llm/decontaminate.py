"""Benchmark decontamination by suffix arrays of the training text.

Texts are lower-cased (A-Z); words are runs of 0-9, a-z and characters from U+0080 on.  Each task cuts its
documents into shards of about SHARD words and builds a suffix array of each: positions sorted by the words
that follow, by prefix doubling, to the depth of the longest benchmark item.  Words that no item holds
can't be part of a match; they sort first and end a suffix.  All suffixes of all items are then searched in
the array together: word by word, each suffix's interval of the array is narrowed by binary search, until it
is empty.  The last interval that wasn't is the longest verbatim match, and its entries are its locations.
Where an interval is as deep as a window (`window` words, or a whole item of fewer), its entries are the
places of that window, and the words there are hit.  Equal windows are one, whatever the number of their items, so
a place counts once for each length of window; their items are looked up once for each document and window.
Since the intervals of one depth are disjoint, the number of those over an entry is the longest match of its place.

The benchmark is a stated query set: it is read in blocks of at most BLOCK bytes of text (an item isn't split), each a
broadcast of that size, and the documents are passed once for each block; the broadcast is freed after its pass.  With
several blocks, a pass leaves the spans of hit words, which are joined by id and digest of the text.  A document is
contaminated if a share of at least `least` of its words is hit.

Null texts have no words, and items without words are nowhere.  Null ids pass through; a null item id counts
as the empty string.  Repeated documents are judged one by one; items with equal texts are all found.
Columns besides ids and texts aren't read, or pass through decontaminate().  Empty tables give an empty
result, or documents without hits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, written

SHARD = 1 << 20
BLOCK = 8 << 20
#: Places, or names of items, that are held at once.
HELD = 1 << 20

#: Upper case to lower case, and to spaces what no word holds.
PLAIN = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


class Suffixes:
    """The suffixes of one block of items, as numbers of words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        known = [(i, w) for i, t in sorted(items) if (w := words_of(t))]
        self.items, split = [i for i, _ in known], [w for _, w in known]
        self.number: dict[bytes, int] = {}
        for item in split:
            for word in item:
                self.number.setdefault(word, len(self.number) + 1)
        sizes = np.array([len(w) for w in split], np.int64)
        self.words = np.array([self.number[w] for item in split for w in item], np.int32)
        self.item = np.repeat(np.arange(len(split)), sizes)
        self.offset = np.arange(len(self.words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.repeat(sizes, sizes)
        self.left = whole - self.offset
        self.longest = int(sizes.max()) if len(sizes) else 0
        #: The depth at which an interval holds the places of a window; 0 where none starts, or one that started before.
        self.depth = np.where(self.left >= window, window, np.where((whole < window) & (self.offset == 0), whole, 0))
        self.window = np.zeros(len(self.words), np.int64)
        first: dict[bytes, int] = {}
        owners: list[list[int]] = []
        for k in np.flatnonzero(self.depth).tolist():
            w = first.setdefault(self.words[k : k + self.depth[k]].tobytes(), len(first))
            if w < len(owners):
                self.depth[k] = 0
            else:
                owners.append([])
            self.window[k] = w
            if not owners[w] or owners[w][-1] != self.item[k]:
                owners[w].append(int(self.item[k]))
        #: The items of each window.
        self.owners = [np.array(o, np.int32) for o in owners]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """The positions of s with numbers over 0, sorted by what follows to the next 0 or to the depth.  s ends
    in at least three zeros."""
    at = np.flatnonzero(s).astype(np.int64)
    wide = max(1, int(s.max(initial=0)).bit_length())
    known = 3 if 3 * wide <= 62 else 2  # words that a key of 62 bits holds; numbers have 31 bits
    key, live = s[at].astype(np.int64), np.ones(len(at), bool)
    for k in range(1, known):
        live &= s[at + k] > 0
        key = (key << wide) | np.where(live, s[at + k], 0)
    order = np.argsort(key)
    array, key = at[order], key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    rank = np.zeros(len(s) + 1, np.int64)
    rank[array] = group + 1
    alone = first & np.concatenate([first[1:], [True]]) if len(key) else first
    open_ = np.flatnonzero(~alone & (key & ((1 << wide) - 1) > 0))
    while known < depth and len(open_):
        places = array[open_]
        next_ = rank[np.minimum(places + known, len(s))]
        key = (rank[places] << 32) | next_
        order = np.argsort(key)
        places, key = places[order], key[order]
        array[open_] = places
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        rank[places] = open_[start] + 1
        alone = first & np.concatenate([first[1:], [True]])
        open_ = open_[~alone & (key & 0xFFFFFFFF > 0)]
        known *= 2
    return array


def search(s: np.ndarray, array: np.ndarray, q: Suffixes) -> Iterator[tuple]:
    """Narrows the intervals of all suffixes together.  Yields (kind, depth, suffixes, low, high): for `window` the intervals
    at the depth of a window, for `last` the last of each suffix that isn't empty, and for `step` the distinct intervals of
    a depth, each with its first suffix."""
    live = np.arange(len(q.words))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(array), np.int64)
    depth = 0
    while len(live):
        word = q.words[live + depth]
        a, b = bound(s, array, low, high, word, depth, False), bound(s, array, low, high, word, depth, True)
        some = a < b
        if depth:
            yield "last", depth, live[~some], low[~some], high[~some]
        live, low, high = live[some], a[some], b[some]
        depth += 1
        one = np.unique(low, return_index=True)[1]
        yield "step", depth, live[one], low[one], high[one]
        full = q.depth[live] == depth
        if full.any():
            yield "window", depth, live[full], low[full], high[full]
        more = q.left[live] > depth
        yield "last", depth, live[~more], low[~more], high[~more]
        live, low, high = live[more], low[more], high[more]


def bound(s, array, low, high, word, depth, after: bool) -> np.ndarray:
    """By binary search the first entry of each interval whose word at the depth isn't below (after: is above)."""
    a, b = low.copy(), high.copy()
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        mid = (a + b) >> 1
        inside = a < b
        found = s[array[np.minimum(mid, len(array) - 1)] + depth] if len(array) else word
        right = inside & ((found <= word) if after else (found < word))
        a = np.where(right, mid + 1, a)
        b = np.where(inside & ~right, mid, b)
    return a


class Shard:
    """Documents whose suffix array is built and searched at once."""

    def __init__(self, keep: bool = False):
        self.ids: list = []
        self.words: list[list[bytes]] = []
        self.texts: list | None = [] if keep else None
        self.size = 0

    def add(self, doc_id, text: bytes | None) -> None:
        words = words_of(text)
        self.ids.append(doc_id)
        self.words.append(words)
        if self.texts is not None:
            self.texts.append(text)
        self.size += len(words)

    def layout(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Sizes and starts of the documents in the shard's numbers, and how many there are; a 0 ends each document."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        return sizes, np.cumsum(sizes + 1) - sizes - 1, int((sizes + 1).sum())

    def numbers(self, q: Suffixes) -> np.ndarray:
        _, starts, total = self.layout()
        s = np.zeros(total + max(3, q.longest + 1), np.int32)
        number = q.number.get
        for start, words in zip(starts.tolist(), self.words, strict=True):
            if words:
                s[start : start + len(words)] = [number(w, 0) for w in words]
        return s

    def longest(self, q: Suffixes) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """For each suffix of the block its longest match in the shard, the number of its places, and document and word of the
        first of them in the array."""
        _, starts, _ = self.layout()
        s = self.numbers(q)
        array = suffix_array(s, q.longest)
        length, places, at = (np.zeros(len(q.words), np.int64) for _ in range(3))
        for kind, depth, suffix, low, high in search(s, array, q):
            if kind == "last" and len(suffix):
                length[suffix], places[suffix], at[suffix] = depth, high - low, array[low]
        doc = np.searchsorted(starts, at, "right") - 1
        return length, places, [self.ids[d] for d in doc.tolist()], at - starts[doc]

    def judged(self, q: Suffixes) -> Judged:
        sizes, starts, total = self.layout()
        s = self.numbers(q)
        array = suffix_array(s, q.longest)
        marks, over = np.zeros(total + 1, np.int64), np.zeros(len(array) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        steps: list[tuple] = []
        for kind, depth, suffix, low, high in search(s, array, q):
            if kind == "step":
                over[low] += 1
                over[high] -= 1
                if steps and len(low):  # of the depth before only intervals with entries that end there are of use
                    d, own, a, b = steps[-1]
                    left = b - a
                    np.subtract.at(left, np.searchsorted(a, low, "right") - 1, high - low)
                    steps[-1] = (d, own[left > 0], a[left > 0], b[left > 0])
                steps.append((depth, suffix, low, high))
            elif kind == "window":
                for at in pieces(high - low, HELD):
                    count = high[at] - low[at]
                    entry = np.repeat(low[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    place = array[entry]
                    marks += np.bincount(place, minlength=total + 1)
                    marks -= np.bincount(place + depth, minlength=total + 1)
                    doc = np.searchsorted(starts, place, "right") - 1
                    pairs.append(np.unique(doc * len(q.owners) + np.repeat(q.window[suffix[at]], count)))
        hit = np.cumsum(marks) > 0
        length = np.zeros(total + 1, np.int64)
        length[array] = np.cumsum(over)[: len(array)]
        entry = np.zeros(total + 1, np.int64)
        entry[array] = np.arange(len(array))
        #: The first place of the longest match of each document; a suffix of the benchmark that matches there.
        best = [a + int(np.argmax(length[a : a + n])) if n else 0 for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        of_depth = {d: (low, own) for d, own, low, _ in steps}
        longest, item = [], []
        for p, n in zip(best, sizes.tolist(), strict=True):
            d = int(length[p]) if n else 0
            longest.append(d)
            if d:
                low, own = of_depth[d]
                item.append(q.items[q.item[own[np.searchsorted(low, entry[p], "right") - 1]]])
            else:
                item.append(None)
        before = np.concatenate([[0], np.cumsum(hit)])
        at = [p - a if d else None for p, a, d in zip(best, starts.tolist(), longest, strict=True)]
        return Judged(self.ids, sizes, starts, hit, before[starts + sizes] - before[starts], np.unique(np.concatenate(pairs)), longest, item, at)


@dataclass
class Judged:
    ids: list
    sizes: np.ndarray
    starts: np.ndarray
    hit: np.ndarray
    hits: np.ndarray
    pairs: np.ndarray
    longest: list[int]
    item: list[str | None]
    at: list[int | None]

    def windows(self, q: Suffixes) -> list[np.ndarray]:
        """The distinct windows in each document."""
        n = max(1, len(q.owners))
        return np.split(self.pairs % n, np.searchsorted(self.pairs // n, np.arange(1, len(self.ids)))) if self.ids else []

    def spans(self, k: int) -> bytes:
        """Starts and ends of the runs of hit words of a document, as pairs of 64-bit integers."""
        edges = np.diff(np.concatenate([[0], self.hit[self.starts[k] : self.starts[k] + self.sizes[k]], [0]]).astype(np.int8))
        return np.stack([np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)], axis=1).astype("<i8").tobytes()


def pieces(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about `most` counts in all; a larger count is alone."""
    ends, first = np.cumsum(count), 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield slice(first, last)
        first = last


class Found:
    """The names of the items of sets of windows, once for each set while there is room."""

    def __init__(self, q: Suffixes, digest: bool):
        self.q, self.digest, self.known, self.held = q, digest, {}, 0

    def of(self, windows: np.ndarray):
        """The number and the names, or the digest of the names, of the items with such windows."""
        if not len(windows):
            return 0, hashlib.sha256().hexdigest() if self.digest else []
        key = windows.tobytes()
        if (out := self.known.get(key)) is None:
            own = [self.q.owners[w] for w in windows.tolist()]
            # items are in the order of their names
            names = list(dict.fromkeys(self.q.items[i] for i in (np.unique(np.concatenate(own)) if len(own) > 1 else own[0]).tolist()))
            out = len(names), hashlib.sha256(",".join(names).encode()).hexdigest() if self.digest else names
            self.held += len(windows) + (0 if self.digest else len(names))
            if self.held > HELD:
                self.known.clear()
                self.held = len(windows) + len(names)
            self.known[key] = out
        return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator:
    """The benchmark as broadcasts of about BLOCK bytes of text each (a longer item is one alone); each is freed when the next
    is asked for."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(1.5 * size / BLOCK)) if size > BLOCK else 1
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        shared = benchmark.sparkSession.sparkContext.broadcast(Suffixes([(r.item, bytes(r.text)) for r in rows], window))
        yield shared, n
        if n > 1:
            shared.unpersist()


def judge(docs: DataFrame, block, id_col: str, text_col: str, mode: str) -> DataFrame:
    """A row for each document.  mode: `items` gives n_items and items, `digest` n_items and items_sha256, `spans` items, spans and
    _dc_text, the digest of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = {"items": "items array<string>", "digest": "items_sha256 string", "spans": "items array<string>, spans binary, _dc_text binary"}[mode]
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, longest long, longest_item string, longest_at long, {last}"

    def run(batches):
        import pyarrow as pa

        q = block.value
        found, doc_type = Found(q, mode == "digest"), None

        def out(shard: Shard):
            j = shard.judged(q)
            rows, held = [], 0
            for k, windows in enumerate(j.windows(q)):
                n, names = found.of(windows)
                rows.append((j.ids[k], int(j.sizes[k]), int(j.hits[k]), n, j.longest[k], j.item[k], j.at[k], names))
                if mode == "spans":
                    rows[-1] += (j.spans(k), hashlib.sha256(shard.texts[k] or b"").digest())
                held += 1 if mode == "digest" else 1 + n
                if held >= HELD // 8:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows):
            kinds = [doc_type, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string() if mode == "digest" else pa.list_(pa.string()), pa.binary(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
            return pa.RecordBatch.from_arrays(cols, names_of)

        names_of = [id_col, "n_words", "n_hit", "n_items", "longest", "longest_item", "longest_at", *{"digest": ["items_sha256"], "items": ["items"], "spans": ["items", "spans", "_dc_text"]}[mode]]
        shard = Shard(mode == "spans")
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.size >= SHARD or len(shard.ids) >= 50_000:
                    yield from out(shard)
                    shard = Shard(mode == "spans")
        if shard.ids:
            yield from out(shard)

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def merged(passes: list[DataFrame], id_col: str) -> DataFrame:
    """The rows of several passes as one for each document; repeated rows of a document have become one."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    best = F.struct(-F.col("longest"), "longest_at", "longest_item")
    rows = every.groupBy(id_col, "_dc_text").agg(
        F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), F.min_by("longest_item", best).alias("longest_item"),
        F.min_by("longest_at", best).alias("longest_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.collect_set("spans").alias("spans"),
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hits = []
            for spans in batch.column("spans").to_pylist():
                runs = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in spans])
                runs = runs[np.argsort(runs[:, 0])]
                ends = np.maximum.accumulate(np.concatenate([[0], runs[:, 1]]))
                hits.append(int(np.maximum(0, runs[:, 1] - np.maximum(runs[:, 0], ends[:-1])).sum()))
            at = batch.schema.get_field_index("spans")
            yield batch.set_column(at, "n_hit", pa.array(hits, pa.int64()))

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, _dc_text binary, n_words long, longest long, longest_item string, longest_at long, items array<string>, n_hit long"
    return rows.mapInArrow(run, schema).withColumn("n_items", F.size("items").cast("long"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, least: float = 0.05, digest: bool = False,
) -> DataFrame:
    """One row for each document: its id, n_words, n_hit, n_items and items (ids with windows in it, sorted; with `digest`
    items_sha256, of the ids joined by commas), contaminated, and its longest match with any item: longest (words),
    longest_at (its first place) and longest_item (the first of the items that match there)."""
    passes, joined = [], None
    with scratch(docs.sparkSession) as keep:
        for block, n in blocks_of(benchmark, item_col, item_text_col, window):
            found = judge(docs, block, id_col, text_col, "spans" if n > 1 else "digest" if digest else "items")
            passes.append(keep(found.dropDuplicates([id_col, "_dc_text"]), "hits") if n > 1 else found)
        if len(passes) > 1:
            joined = written(merged(passes, id_col).withColumnRenamed(id_col, "_dc_id"), "hits")
    if joined is not None:
        own = docs.select(id_col, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("_dc_own"))
        same = F.col(id_col).eqNullSafe(F.col("_dc_id")) & (F.col("_dc_own") == F.col("_dc_text"))
        found = own.join(joined, same).drop("_dc_id", "_dc_own", "_dc_text")
        if digest:
            found = found.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).drop("items")
    # the quotient of equal shares is exact
    bad = (F.col("n_hit") > 0) & (F.col("n_hit").cast("double") / F.col("n_words") >= F.lit(float(least)))
    out = "items_sha256" if digest else "items"
    return found.select(id_col, "n_words", "n_hit", "n_items", out, F.coalesce(bad, F.lit(False)).alias("contaminated"), "longest", "longest_item", "longest_at")


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for each word of each item that stands in a document: item, position, and the longest verbatim match from there on:
    length in words, places, and doc_id and doc_position of one of them (the smallest id that a task has found first).  Each
    task returns its best for each word of the benchmark."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(block) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            q, own = block.value, {}

            def take(shard: Shard):
                length, places, ids, at = shard.longest(q)
                for k in np.flatnonzero(length).tolist():
                    n, m, doc, p = own.get(k, (0, 0, None, 0))
                    if length[k] > n:
                        own[k] = (int(length[k]), int(places[k]), ids[k], int(at[k]))
                    elif length[k] == n:
                        first = min((doc, p), (ids[k], int(at[k])), key=lambda x: (x[0] is None, x))
                        own[k] = (n, m + int(places[k]), *first)

            shard, doc_type = Shard(), None
            for batch in batches:
                doc_type = batch.schema.field(0).type
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if shard.size >= SHARD or len(shard.ids) >= 50_000:
                        take(shard)
                        shard = Shard()
            if shard.ids:
                take(shard)
            rows = [(q.items[q.item[k]], int(q.offset[k]), *v) for k, v in own.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), doc_type or pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "position", "length", "places", id_col, "doc_position"])

        return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"item string, position long, length long, places long, `{id_col}` {kind}, doc_position long")

    found = None
    for block, n in blocks_of(benchmark, item_col, item_text_col, 1):
        rows = written(of(block), "matches") if n > 1 else of(block)
        found = rows if found is None else found.union(rows)
    longest = F.max("length").over(Window.partitionBy("item", "position"))
    found = found.withColumn("_longest", longest).filter("length = _longest")
    return found.groupBy("item", "position").agg(
        F.max("length").alias("length"), F.sum("places").alias("places"), F.min_by(id_col, F.struct(id_col, "doc_position")).alias(id_col), F.min_by("doc_position", F.struct(id_col, "doc_position")).alias("doc_position")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that aren't contaminated; documents of one id stay or go together, null ids stay."""
    bad = contamination(docs, benchmark, id_col, **options).filter("contaminated").select(F.col(id_col).alias("_dc_id")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("_dc_id"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), digest=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_at")
