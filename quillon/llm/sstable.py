"""Token ids in sorted-string-table shards.

A shard is one immutable file of documents in ascending order of their ids:

    blocks        entries of about BLOCK bytes; keys share prefixes, each RESTART-th entry spells its key out
    block index   for each block its last key, offset, size and number of entries (sparse: one key a block)
    Bloom filter  over the keys, BITS bits each
    footer        fixed size: where index and filter lie, numbers of documents and tokens, width, CRC-32, magic

    entry   varints (shared, rest, value bytes), the rest of the key, the ids as unsigned 16- or 32-bit integers
    block   entries, the offsets of the restarts (unsigned 32-bit) and their number

A key is the id as eight bytes, big-endian with the sign bit flipped, so bytes sort as numbers; a null id has
the empty key and sorts first.  Equal ids stay apart, in the order of the XXH64 of their texts and then of the texts,
and may lie in several shards.  Null text counts as empty:
its only id is the end id.  Columns besides id and text are not read.  An empty table makes no shard and
gives an empty result.

Writing: documents are range-partitioned by id and XXH64 of the text, so that no id is one task, into shards of about
SHARD[0] to SHARD[1] bytes of text, and each task streams its partition to a file of its own
name and moves it to its place, so a task that runs again leaves the same file.  The manifest has a row for each
shard, 200,000 of them over 100 TB.  Reading and lookup() are tasks over shards: the Bloom filter says no, or binary
search over the block index and then over a block's restarts finds the entry.  Files lie in the shared
folder; any file system that pyarrow.fs knows by URI will do.
"""

from __future__ import annotations

import bisect
import json
import math
import os
import re
import struct
import sys
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Chunks, kept, vocabulary_file, word_pattern
from .common import new_path

BLOCK, RESTART, BITS, PROBES = 1 << 16, 16, 10, 7
MAGIC = b"TOKSST02"
#: Bytes of text of a shard, from small inputs to large ones, and the number of shards at which they start to grow.
SHARD, SHARDS = (16 << 20, 512 << 20), 4096
FOOTER = struct.Struct("<QQQQQQII8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def hashed(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key, 1)


def probes(h: int, bits: int) -> list[int]:
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Takes entries in ascending order; holds one block, the index and eight bytes a key for the filter."""

    def __init__(self, file, width: int):
        self.file, self.width = file, width
        self.block, self.restarts, self.in_block = bytearray(), [], 0
        self.last, self.at, self.index, self.hashes = b"", 0, bytearray(), array("Q")
        self.docs = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.docs or key != self.last:
            self.hashes.append(hashed(key))
        self.last, self.in_block = key, self.in_block + 1
        self.docs, self.tokens = self.docs + 1, self.tokens + len(value) // self.width
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.in_block:
            return
        data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        self.index += varint(len(self.last)) + self.last + struct.pack("<QII", self.at, len(data), self.in_block)
        self.file.write(data)
        self.at += len(data)
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self.flush()
        bits = max(64, len(self.hashes) * BITS)
        bloom = bytearray((bits + 7) // 8)
        for h in self.hashes:
            for p in probes(h, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index, bloom = bytes(self.index), bytes(bloom)
        self.file.write(index + bloom)
        check = zlib.crc32(bloom, zlib.crc32(index))
        self.file.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.tokens, self.width, check, MAGIC))


class Reader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = self.part(size - FOOTER.size, FOOTER.size)
        at, n, bloom_at, self.bits, self.docs, self.tokens, self.width, check, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index, self.bloom = self.part(at, n), self.part(bloom_at, (self.bits + 7) // 8)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != check:
            raise ValueError("the shard's index is damaged")
        self.lasts, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            self.lasts.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QII", index, at + n))
            at += n + 16

    def part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = read_varint(block, at)
            rest, at = read_varint(block, at)
            n, at = read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, block[at : at + n]
            at += n

    def opened(self, k: int) -> tuple[bytes, list[int], int]:
        at, n, _ = self.blocks[k]
        block = self.part(at, n)
        (count,) = struct.unpack_from("<I", block, n - 4)
        return block, list(struct.unpack_from(f"<{count}I", block, n - 4 - 4 * count)), n - 4 - 4 * count

    def __iter__(self):
        for k in range(len(self.blocks)):
            block, _, end = self.opened(k)
            yield from self.entries(block, 0, end)

    def get(self, key: bytes) -> list[bytes]:
        """The values of all entries of a key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(hashed(key), self.bits)):
            return []
        out = []
        for k in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            block, restarts, end = self.opened(k)
            spelled = [next(self.entries(block, r, end))[0] for r in restarts]
            start = restarts[max(0, bisect.bisect_left(spelled, key) - 1)]
            for found, value in self.entries(block, start, end):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
        return out


def opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


#: A run of letters and then of signs, which the vocabulary's pattern always parts; an apostrophe may start a contraction.
WORD_AND_SIGNS = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
PLAIN = re.compile(r"[A-Za-z]*[!-&(-/:-@\[-`{-~]*")
#: Chunks, and words below them, that the caches of a Python worker keep.
CHUNKS, WORDS = 500_000, 1_000_000


def plain_words(spec: dict) -> None:
    """Refuses a vocabulary file whose words or added tokens could reach over what WORD_AND_SIGNS parts."""
    import regex

    probe = "ab!#&(-/:@[_`{~"
    added = [t["content"] for t in spec["added_tokens"]]
    if regex.findall(word_pattern(spec), probe) != [probe[:2], probe[2:]] or any(PLAIN.fullmatch(t) for t in added):
        raise ValueError("only vocabularies that part letters from signs are supported")


class LibraryIds:
    """Chunks of text to ids with the tokenizers library.  A chunk of letters and signs is encoded as its word in lower
    case and its signs, so the library sees each of these once while the caches have room; a Python worker keeps them
    from task to task."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wide = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {b"": b""}

    def encode(self, parts: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode(errors="replace") for p in parts], add_special_tokens=False)
        own = [array("I", e.ids) for e in found]
        if sys.byteorder == "big":
            for ids in own:
                ids.byteswap()
        return {p: ids.tobytes() for p, ids in zip(parts, own, strict=True)}

    def many(self, chunks: list[bytes]) -> list[bytes]:
        split, known = [], self.known
        for chunk in chunks:
            m = WORD_AND_SIGNS.fullmatch(chunk)
            split.append((m[1].lower(), m[2]) if m else (chunk, b""))
        missing = {part for pair in split for part in pair if part not in known}
        new = self.encode(list(missing)) if missing else {}
        if len(known) < WORDS:
            known.update((p, i) for p, i in new.items() if len(p) < 64)
        get = lambda p: known[p] if p in known else new[p]
        return [get(a) + get(b) if b else get(a) for a, b in split]


def library_chunks(content: bytes) -> tuple[LibraryIds, Chunks]:
    library = LibraryIds(content)
    return library, Chunks(library.many, CHUNKS)


def write_shards(
    docs: DataFrame, folder: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shards: int | None = None
) -> DataFrame:
    """Encodes each text, appends the end id and writes the shards; the manifest, also a Parquet table in the
    folder: path, first, last (keys), n_docs, n_tokens and start (tokens before the shard)."""
    spark = docs.sparkSession
    file_content = vocabulary_file(vocab_path)
    plain_words(json.loads(file_content))
    content = spark.sparkContext.broadcast(file_content)
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        shards = max(1, math.ceil(size / min(max(SHARD[0], size // SHARDS), SHARD[1])))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        library, chunks = kept("library", content.value, lambda: library_chunks(content.value))
        end = np.array([end_id], "<u4").tobytes()
        kind = f"<u{library.wide}"
        writer, first = None, b""
        context = TaskContext.get()
        name = f"shard-{context.partitionId():08d}.sst"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = key_of(doc_id)
                if writer is None:
                    system, path = opened(folder)
                    system.create_dir(path, recursive=True)
                    draft = f"{path}/_{name}-{context.taskAttemptId()}"
                    file = system.open_output_stream(draft)
                    writer, first = Writer(file, library.wide), key
                ids = b"".join([*chunks.stream(text or b""), end])
                writer.add(key, np.frombuffer(ids, "<u4").astype(kind).tobytes())
        if writer is not None:
            writer.close()
            file.close()
            system.move(draft, f"{path}/{name}")
            row = [[f"{folder}/{name}"], [first], [writer.last], [writer.docs], [writer.tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                ["path", "first", "last", "n_docs", "n_tokens"],
            )

    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    placed = placed.withColumn("hash", F.xxhash64("text"))  # the samples for the ranges hold no texts
    placed = placed.repartitionByRange(shards, "id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    made = placed.mapInArrow(run, "path string, first binary, last binary, n_docs long, n_tokens long").collect()
    start, rows = 0, []
    for r in sorted(made, key=lambda r: (bytes(r.first), bytes(r.last), r.path)):
        rows.append((*r, start))
        start += r.n_tokens
    schema = "path string, first binary, last binary, n_docs long, n_tokens long, start long"
    manifest = spark.createDataFrame(rows, schema)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the shards: its id, start (tokens of all documents before it), n_tokens and its
    ids, or with `digest` ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("path", "start")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = opened(path)
                ids, starts, counts, last = [], [], [], []

                def out(cols):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()))
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [id_col, "start", "n_tokens", "ids_crc32" if digest else "ids"])

                with system.open_input_file(at) as file:
                    reader, held = Reader(file), 0
                    for key, value in reader:
                        own = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                        ids.append(id_of(key))
                        starts.append(start)
                        counts.append(len(own))
                        last.append(zlib.crc32(own.tobytes()) if digest else own.astype(np.int32))
                        start += len(own)
                        held += 1 if digest else len(own)
                        if held >= 1 << 18:
                            yield out((ids, starts, counts, last))
                            ids, starts, counts, last, held = [], [], [], [], 0
                    if ids:
                        yield out((ids, starts, counts, last))

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    value = "ids_crc32 long" if digest else "ids array<int>"
    return manifest.repartition(tasks).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, {value}")


def lookup(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id and ids of each asked document that a shard holds.  The keys meet the shards that can hold them
    by the manifest (a row for each shard, broadcast), and each task opens its shards."""
    rows = spark.read.parquet(f"{folder}/manifest").select("path", "first", "last").collect()
    shards = sorted((bytes(r.first), bytes(r.last), r.path) for r in rows)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        firsts, readers = [s[0] for s in shards], {}
        for batch in batches:
            ids, values = [], []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    if not shards[k][0] <= key <= shards[k][1]:
                        continue
                    if k not in readers:
                        if len(readers) > 16:
                            readers.clear()
                        system, at = opened(shards[k][2])
                        readers[k] = Reader(system.open_input_file(at))
                    for value in readers[k].get(key):
                        ids.append(doc_id)
                        values.append(np.frombuffer(value, f"<u{readers[k].width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int32()))], [id_col, "ids"])

    asked = keys.select(F.col(id_col).cast("long")).distinct().repartitionByRange(max(1, len(shards)), id_col)
    return asked.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, folder, digest=True)
