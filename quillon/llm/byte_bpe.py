"""Byte-level BPE by overlapping chunks, and decoding by joining raw bytes.

1. A long text is dealt out as chunks of CHUNK characters, each followed by OVERLAP characters of the next one, and every chunk is
   split by the pattern from its own start, which may lie within a match.
2. Neighbours are stitched where their borders resynchronise: the first place within the overlap at which both have a border.
   From there on they split alike, since a match depends on what follows alone.  The left chunk's borders there are those of
   the whole text, because a run of letters or digits has ended in it before (such a run ends in a border wherever
   splitting began), and because matches that could have gone on or looked past the chunk's end are left out.
   A stitch follows no white space, whose matches look one character further, so that a piece splits as it does in its text.
3. What lies between two stitches is a piece, which is split again and encoded, each match by itself.  Chunks that no
   stitch parts are one piece, so nothing is lost where a run spans an overlap, or a chunk has no run at all.
4. Digests and decoded bytes follow the pieces of a text in their order, one after another.

A text of a single chunk is a piece as it is.  A match is merged whole, except that one of more than LONG bytes is cut where two
bytes meet that no token holds next to each other, which no merge can cross.  Null text counts as empty and has no
tokens; invalid UTF-8 counts as replacement characters.  Ids of rows are only carried: null ids and repeated rows pass row by
row.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import CACHED, kept, vocabulary_file
from .common import new_path, scratch

#: Characters of a chunk, and of the next chunk that it holds as well.
CHUNK, OVERLAP = 8192, 256
#: Characters that must follow a match for it to be the same in a longer text: the pattern looks no farther.
GUARD = 3
#: Bytes of a match beyond which it is cut where no token holds both neighbours.
LONG = 1 << 16
#: Ends of runs, which are borders wherever splitting began.
RUNS = r"\p{L}(?!\p{L})|\p{N}(?!\p{N})"


class Known(dict):
    """The ids of words; those that came first are kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < CACHED and len(word) < 64:
            self[word] = ids
        return ids


class Codec:
    """Ranks of tokens in a file of lines `base64 rank`, and the pattern whose matches are encoded each by itself."""

    def __init__(self, content: bytes, pattern: str):
        import numpy as np
        import regex

        pairs = [line.split() for line in content.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.words, self.runs, self.space = regex.compile(pattern), regex.compile(RUNS), regex.compile(r"\s")
        self.joined = np.zeros(1 << 16, bool)
        self.joined[[a << 8 | b for token in self.ranks for a, b in zip(token, token[1:], strict=False)]] = True
        self.known = Known(self.word)

    def merged(self, data: bytes) -> list[int]:
        """Always the pair whose joined bytes have the lowest rank, of these the leftmost."""
        ranks, n = self.ranks, len(data)
        after, before = [*range(1, n + 1), 0], [*range(-1, n)]  # where the next and the last token start; 0 after what is gone
        heap = [r << 40 | k for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            rank, k = best >> 40, best & (1 << 40) - 1
            middle = after[k]
            if not middle or middle >= n or ranks.get(data[k : (end := after[middle])]) != rank:
                continue
            after[k], after[middle], before[end] = end, 0, k
            if k and (r := ranks.get(data[before[k] : end])) is not None:
                heapq.heappush(heap, r << 40 | before[k])
            if end < n and (r := ranks.get(data[k : after[end]])) is not None:
                heapq.heappush(heap, r << 40 | k)
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : after[k]]])
            k = after[k]
        return out

    def parts(self, data: bytes) -> list[bytes]:
        """Bytes that no merge joins with what is beside them."""
        import numpy as np

        if len(data) <= LONG:
            return [data]
        raw = np.frombuffer(data, np.uint8).astype(np.int32)
        cuts = [0, *(np.flatnonzero(~self.joined[raw[:-1] << 8 | raw[1:]]) + 1).tolist(), len(data)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def word(self, word: str) -> bytes:
        data = word.encode()
        own = [self.ranks[data]] if data in self.ranks else [i for part in self.parts(data) for i in self.merged(part)]
        return b"".join(i.to_bytes(4, "little") for i in own)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.words.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def borders(self, text: str, last: bool, size: int, overlap: int) -> tuple[list[int], list[int], bool]:
        """The borders after no white space in the first `overlap` characters of a chunk, those in its overlap with the next chunk, counted from there,
        and whether they are those of the whole text."""
        ends = [m.end() for m in self.words.finditer(text)]
        head = [e for e in ends if e <= overlap and not self.space.match(text, e - 1)]
        tail = [] if last else [e - size for e in ends if size < e <= len(text) - GUARD]
        run = self.runs.search(text)
        return head, tail, run is not None and run.end() <= size


def measured(columns, digest: bool, id_name: str):
    """A record batch of the result from lists of ids, and for each row the id bytes' count, and two values."""
    import pyarrow as pa

    ids, counts, first, second = columns
    kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], [id_name, "n_tokens", *names])


class Sums:
    """What a row of the result holds of a text, from its pieces one after another."""

    def __init__(self, digest: bool):
        self.n, self.digest = 0, digest
        self.ids, self.text = (hashlib.sha256(), hashlib.sha256()) if digest else ([], [])

    def add(self, ids: bytes, text: bytes) -> None:
        self.n += len(ids) // 4
        (self.ids.update if self.digest else self.ids.append)(ids)
        (self.text.update if self.digest else self.text.append)(text)

    def values(self) -> tuple:
        import numpy as np

        if self.digest:
            return self.n, self.ids.hexdigest(), self.text.hexdigest()
        return self.n, np.frombuffer(b"".join(self.ids), "<u4").tolist(), b"".join(self.text)


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of `docs`: its id, n_tokens, and ids (array of int) and decoded (binary), or with `digest` the hex
    SHA-256 of both: ids_sha256 of the ids as little-endian 32-bit integers, decoded_sha256 of the bytes.  The rank file is read on
    the driver and broadcast; its size is checked.  Rows of long texts are a written table."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(vocabulary_file(ranks_path))
    codec = lambda: kept("byte-bpe", content.value + pattern.encode(), lambda: Codec(content.value, pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")

    def whole(batches):
        own = codec()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                sums = Sums(digest)
                ids = own.encode((text or b"").decode(errors="replace"))
                sums.add(ids, own.decode(ids))
                rows.append(sums.values())
            yield measured([batch.column(0), *([r[k] for r in rows] for k in range(3))], digest, "id")

    def chunks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, text in enumerate(batch.column(1).to_pylist()):
                text, row = text.decode(errors="replace"), row + 1
                starts = range(0, max(1, len(text) - overlap), size)
                for some in (starts[k : k + 256] for k in range(0, len(starts), 256)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(some), pa.int64()),
                            pa.array([batch.column(0)[at].as_py()] * len(some), batch.column(0).type),
                            pa.array([s // size for s in some], pa.int32()),
                            pa.array([s == starts[-1] for s in some], pa.bool_()),
                            pa.array([text[s : s + size + overlap] for s in some], pa.string()),
                        ],
                        ["row", "id", "k", "last", "chunk"],
                    )

    def borders(batches):
        import pyarrow as pa

        own = codec()
        for batch in batches:
            found = [own.borders(c, last, size, overlap) for c, last in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for h, _, _ in found], ints), pa.array([t for _, t, _ in found], ints), pa.array([a for _, _, a in found], pa.bool_())],
                ["row", "k", "head", "tail", "sure"],
            )

    def encoded(batches):
        """Parts that follow one another within a piece are joined before they are encoded."""
        import pyarrow as pa

        own, last, held, kinds = codec(), None, [], None

        def closed():
            ids = own.encode("".join(held))
            values = (*last, len(ids), pa.compress(ids, codec="zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], ["row", "id", "piece", "size", "ids"])

        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type, batch.column(2).type, pa.int32(), pa.binary()]
            for *key, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last is not None and key != last:
                    yield closed()
                    held = []
                last = key
                held.append(text)
        if last is not None:
            yield closed()

    def gathered(batches):
        import pyarrow as pa

        own, row, name, sums, kind = codec(), None, None, None, None
        one = lambda: measured([pa.array([name], kind), *([v] for v in sums.values())], digest, "id")
        for batch in batches:
            kind = batch.column(1).type
            for r, i, length, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = pa.decompress(data, decompressed_size=length, codec="zstd", asbytes=True)
                if r != row:
                    if row is not None:
                        yield one()
                    row, name, sums = r, i, Sums(digest)
                sums.add(ids, own.decode(ids))
        if row is not None:
            yield one()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("chars"))
    single = texts.filter(F.col("chars") <= size + overlap).select("id", "text").mapInArrow(whole, out)
    with scratch(spark) as written:
        dealt = texts.filter(F.col("chars") > size + overlap).select("id", "text").mapInArrow(chunks, f"row long, id {kind}, k int, last boolean, chunk string")
        dealt = written(dealt, "byte-bpe-chunks", maxRecordsPerFile=2048)  # files that several tasks can read
        found = dealt.select("row", "k", "last", "chunk").mapInArrow(borders, "row long, k int, head array<int>, tail array<int>, sure boolean")
        text = Window.partitionBy("row").orderBy("k")  # a row for each chunk, and a text has at most 2 GB
        before = F.lag(F.when(F.col("sure") | (F.col("k") == 0), F.col("tail"))).over(text)
        cut = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(before, F.col("head"))))
        after = F.lead("cut").over(text)
        cuts = found.select("row", "k", cut.alias("cut")).select(
            F.col("row").alias("r"),
            F.col("k").alias("c"),
            F.coalesce("cut", F.lit(0)).alias("start"),
            (F.coalesce(after, F.lit(0)) + size).alias("end"),
            F.count("cut").over(text.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"),
            (F.col("cut").isNotNull() & (after.isNotNull() | F.lead("k").over(text).isNull())).alias("alone"),
        )
        end = F.when(F.col("last"), size + overlap).otherwise(F.col("end"))
        part = F.substring("chunk", F.col("start") + 1, end - F.col("start")).alias("part")
        parts = dealt.join(cuts, (F.col("row") == F.col("r")) & (F.col("k") == F.col("c"))).select("row", "id", "piece", "k", "alone", part)
        # Nearly all pieces are one part.  The parts of the others are brought together, in their order.
        several = parts.filter("NOT alone").repartition("row", "piece").sortWithinPartitions("row", "piece", "k")
        ids = [p.select("row", "id", "piece", "part").mapInArrow(encoded, f"row long, id {kind}, piece long, size int, ids binary") for p in (parts.filter("alone"), several)]
        ids = ids[0].union(ids[1]).repartition("row").sortWithinPartitions("row", "piece")
        path = new_path(spark, "byte-bpe")
        long = ids.select("row", "id", "size", "ids").mapInArrow(gathered, out)
        long.write.parquet(path)
    rows = single.union(spark.read.schema(long.schema).parquet(path))
    return rows.select(F.col("id").alias(id_col), *rows.columns[1:])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
