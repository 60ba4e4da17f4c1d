"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A vocabulary file of the tokenizers library (BPE with word ends, byte-level symbols) is read into a
transducer.  Words leave it as soon as they end.  Within a word without an end in sight, tokens leave it
once they are stable: sufficient_lookahead() bounds how far what follows can reach back.

Why the bound holds.  Give the same prefix two different continuations and apply the merges in order of
rank.  The two segmentations of the prefix first agree up to its end.  They come to differ one agreed
token farther to the left only by a merge (a, b) whose left part is the last agreed token; its right part
starts where they differ.  There, either side holds a token that starts with the previous such left part,
and each further step needs a merge of higher rank.  So the reach is at most the heaviest chain of merges
of ascending rank in which each right part starts with the previous left part, weighing the left parts'
lengths.  Tokens that end before that reach are final, and since no merge crosses a token's border, the
rest can be encoded without them.

Texts pass in pieces of PIECE bytes.  A run without white space that is longer goes through a Transducer, whose state is
bounded whatever the length: an unfinished character, the start of an added token, what follows the last character
that normalization can't reach over (in texts that write letters; a run of combining marks is held whole), the start of a
literal of the pattern, and a window of symbols of the open word.  Caches of chunks and words are bounded, and a
Python worker keeps them from task to task.  Null text counts as empty and has no tokens.  Invalid UTF-8
counts as replacement characters.  Columns besides id and text are not read; null ids and repeated rows
pass through row by row.  An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are taken at once.
PIECE = 1 << 16
#: Chunks that a cache keeps.
CACHED = 500_000
SPACE = re.compile(rb"\s")


def byte_symbols() -> list[str]:
    """The printable character for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern of literals, classes and repeated classes; other patterns are refused."""
    import regex

    parts = regex.findall(r"(?:\[(?:[^\]\\]|\\.)*\]\+?|[^|\[\]])+", pattern)
    plain = r"(?:[^\\.^$*+?{}\[\]|()]|\\[^\w\s])+|\[(?:[^\]\\]|\\.)*\]\+?"
    if "|".join(parts) != pattern or not all(regex.fullmatch(plain, p) for p in parts):
        raise ValueError("only patterns of literals and classes are supported")
    return parts


@functools.cache
def reached() -> frozenset[str]:
    """Characters that normalization may join with what is before them."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in map(chr, range(0x300, 0x30000)):
        way = unicodedata.decomposition(c)
        if way and way[0] != "<" and " " in way:
            out.add(chr(int(way.split()[1], 16)))
    return frozenset(out)


def border(c: str) -> bool:
    """Whether normalization can't reach from before a character to it or beyond."""
    if c < "\x80":
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return all(not unicodedata.combining(x) and x not in reached() for x in (c, first))


def word_pattern(spec: dict) -> str:
    """The pattern of words of a vocabulary file.  Files that keep case or white space are refused: texts are cut
    at white space before they are encoded."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("only the normalizers NFC, Replace and Lowercase are supported, in this order")
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in parts] != ["Split", "ByteLevel"] or parts[0]["behavior"] != "Removed" or not parts[0]["invert"]:
        raise ValueError("only a Split that keeps what it finds and ByteLevel are supported")
    return parts[0]["pattern"]["Regex"]


class Vocabulary:
    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain BPE models are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = word_pattern(spec)
        parts = alternatives(self.pattern)
        #: Patterns that match runs of any length; more characters than any other alternative may match.
        self.runs = [p for p in parts if p.endswith("]+")]
        self.margin = 1 + max(len(p) for p in parts if p[0] != "[") if any(p[0] != "[" for p in parts) else 2
        self.decoder = spec.get("decoder")
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.longest = max(map(len, self.ids))
        self.reach = sufficient_lookahead(pairs, self.end)


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int | None:
    """Symbols of lookahead after which a token is final; None if a merge uses a token that only a later one makes."""
    made: set[str] = set()
    reach: dict[str, int] = {}
    longest = 1
    for left, right in merges:
        for part in (left, right):
            bare = part.removesuffix(end) if end else part
            if len(bare) > 1 and part not in made:
                return None
        made.add(left + right)
        longest = max(longest, len(left) + len(right))
        before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), before + len(left))
    return max(reach.values(), default=0) + longest


class Encoder:
    """Text to ids, a piece at a time."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.words = regex.compile(vocabulary.pattern)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None
        self.symbols = byte_symbols()
        self.seen: dict[str, list[int]] = {}
        self.window = None if vocabulary.reach is None else 2 * vocabulary.reach + 2 * vocabulary.longest

    def merged(self, symbols: list[str]) -> list[str]:
        """Always the pair of lowest rank, of these the leftmost."""
        ranks = self.v.ranks
        if len(symbols) > 24:
            return self.merged_by_heap(symbols)
        none = len(ranks)
        rank = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while rank and (best := min(rank)) < none:
            k = rank.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del rank[k]
            if k:
                rank[k - 1] = ranks.get((symbols[k - 1], symbols[k]), none)
            if k < len(rank):
                rank[k] = ranks.get((symbols[k], symbols[k + 1]), none)
        return symbols

    def merged_by_heap(self, symbols: list[str]) -> list[str]:
        ranks, n = self.v.ranks, len(symbols)
        tokens: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            if tokens[k] != left or (m := after[k]) >= n or tokens[m] != right:
                continue
            tokens[k], tokens[m], after[k] = left + right, None, after[m]
            if after[m] < n:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := ranks.get((tokens[a], tokens[b]))) is not None:
                    heapq.heappush(heap, (r, a, tokens[a], tokens[b]))
        return [t for t in tokens if t is not None]

    def word(self, word: str) -> Iterator[str]:
        """The tokens of a word, each as soon as it is stable."""
        symbols = [self.symbols[b] for b in word.encode()]
        start, n, window = 0, len(symbols), self.window
        while window and n - start > window:
            stable = start + window - self.v.reach
            for token in self.merged(symbols[start : start + window]):
                if start + len(token) > stable:
                    break
                start += len(token)
                yield token
        rest = symbols[start:]
        rest[-1] += self.v.end
        yield from self.merged(rest)

    def plain(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def known(self, word: str) -> list[int]:
        if (own := self.seen.get(word)) is None:
            ids = self.v.ids
            own = [ids[t] for t in self.word(word) if t in ids]
            if len(self.seen) < CACHED // 2 and len(word) < 64:
                self.seen[word] = own
        return own

    def chunk(self, chunk: bytes) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers, of text without white space in it."""
        text, out = chunk.decode(errors="replace"), []
        parts = [(text, None)]
        if self.special and any(t in text for t in self.v.added):
            parts, at = [], 0
            for m in self.special.finditer(text):
                parts += [(text[at : m.start()], None), ("", self.v.added[m[0]])]
                at = m.end()
            parts.append((text[at:], None))
        for part, special in parts:
            if special is not None:
                out.append(special)
                continue
            part = self.plain(part)
            for word in self.words.findall(part) if len(part) < PIECE else (m[0] for m in self.words.finditer(part)):
                out += self.known(word)
        return b"".join(i.to_bytes(4, "little") for i in out)

    def many(self, chunks: list[bytes]) -> list[bytes]:
        return [self.chunk(c) for c in chunks]


class Transducer:
    """Encodes a run of text without white space, a piece at a time."""

    def __init__(self, encoder: Encoder):
        import regex

        self.e, self.v = encoder, encoder.v
        self.bytes = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.runs = [regex.compile(p) for p in self.v.runs]
        self.raw = self.held = self.rest = ""
        self.run, self.symbols = None, []

    def feed(self, piece: bytes, last: bool = False) -> bytes:
        """The ids that are stable by now."""
        text, out, at = self.raw + self.bytes.decode(piece, last), [], 0
        for m in self.e.special.finditer(text) if self.e.special else ():
            out += self.normal(text[at : m.start()], True)
            out.append(self.v.added[m[0]])
            at = m.end()
        end = len(text)
        if not last:  # the longest start of an added token waits
            end -= max((k for t in self.v.added for k in range(1, min(len(t), len(text) - at + 1)) if text.endswith(t[:k])), default=0)
        self.raw = text[end:]
        out += self.normal(text[at:end], last)
        return array("I", out).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in out)

    def normal(self, text: str, last: bool) -> list[int]:
        text = self.held + text
        end = len(text) if last else next((k for k in range(len(text) - 1, -1, -1) if border(text[k])), 0)
        self.held = text[end:]
        return self.split(self.e.plain(text[:end]), last)

    def split(self, text: str, last: bool) -> list[int]:
        """Words of the pattern; the last may be open, and then its symbols go on to the merges as they come."""
        text, out, at = self.rest + text, [], 0
        self.rest = ""
        if self.run is not None:
            m = self.run.match(text)
            at = m.end() if m else 0
            out += self.grown(text[:at])
            if at == len(text) and not last:
                return out
            out += self.closed()
        while m := self.e.words.search(text, at):
            at = m.start()
            if not last:
                if len(text) - at < self.v.margin:
                    break
                if m.end() == len(text) and self.e.window:
                    self.run = next((r for r in self.runs if (x := r.match(text, at)) and x.end() == m.end()), None)
                    if self.run is not None:
                        return out + self.grown(m[0])
                if m.end() == len(text):
                    break
            out += self.e.known(m[0])
            at = m.end()
        else:
            at = len(text) if last else max(at, len(text) - self.v.margin)
        self.rest = text[at:]
        return out

    def grown(self, part: str) -> list[int]:
        """The stable tokens of the open word, which goes on."""
        self.symbols += [self.e.symbols[b] for b in part.encode()]
        start, out, ids = 0, [], self.v.ids
        while len(self.symbols) - start > self.e.window:
            stable = start + self.e.window - self.v.reach
            for token in self.e.merged(self.symbols[start : start + self.e.window]):
                if start + len(token) > stable:
                    break
                start += len(token)
                if token in ids:
                    out.append(ids[token])
        del self.symbols[:start]
        return out

    def closed(self) -> list[int]:
        self.run, rest, self.symbols = None, self.symbols, []
        rest[-1] += self.v.end
        return [self.v.ids[t] for t in self.e.merged(rest) if t in self.v.ids]


class Chunks:
    """Splits texts at white space, and keeps the ids of the chunks that came first."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = CACHED, long: Callable[[], Transducer] | None = None):
        self.encode, self.most, self.known, self.long = encode, most, {}, long

    def ids(self, chunks: list[bytes]) -> bytes:
        known = self.known
        missing = [c for c in set(chunks) if c not in known]
        if not missing:
            return b"".join(map(known.__getitem__, chunks))
        new = dict(zip(missing, self.encode(missing), strict=True))
        if len(known) < self.most:
            known.update((c, i) for c, i in new.items() if len(c) < 64)
        return b"".join([known.get(c) or new.get(c, b"") for c in chunks])

    def stream(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text, piece by piece; a chunk that a piece cuts waits for the next piece, unless it is long."""
        if len(text) <= PIECE:
            yield self.ids(text.split())
            return
        held, open_ = b"", None
        for at in range(0, len(text), PIECE):
            piece = held + text[at : at + PIECE] if held else text[at : at + PIECE]
            held = b""
            if open_ is not None:
                space = SPACE.search(piece)
                end = space.start() if space else len(piece)
                yield open_.feed(piece[:end], space is not None)
                if space is None:
                    continue
                open_, piece = None, piece[end:]
            chunks = piece.split()
            held = chunks.pop() if chunks and not piece[-1:].isspace() else b""
            yield self.ids(chunks)
            if len(held) >= PIECE and self.long:
                open_ = self.long()
                yield open_.feed(held)
                held = b""
        if open_ is not None:
            yield open_.feed(b"", True)
        elif held:
            yield self.ids([held])


class Decoder:
    """Ids to text, a few at a time.  Without a decoder of its own, a vocabulary's tokens stand apart by
    spaces; with a byte-level one, bytes are put together to characters, which may span tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.apart = vocabulary.decoder is None
        self.reset()
        if self.apart:
            self.table = {i: t for i, t in vocabulary.texts.items()}
        else:
            byte_of = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
            added = set(vocabulary.added)
            self.table = {i: t.encode() if t in added else b"".join(byte_of[c] for c in t) for i, t in vocabulary.texts.items()}

    def reset(self) -> None:
        self.begun = False
        self.bytes = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if not self.apart:
            return self.bytes.decode(b"".join(map(self.table.__getitem__, ids)))
        out = " ".join(map(self.table.__getitem__, ids))
        out, self.begun = " " + out if self.begun else out, True
        return out

    def close(self) -> str:
        out = "" if self.apart else self.bytes.decode(b"", final=True)
        self.reset()
        return out


_OWN: dict[tuple, object] = {}


def kept(kind: str, content: bytes, make: Callable[[], object]):
    """What make() gives for a vocabulary file, kept for the later tasks of this Python worker; the last file alone."""
    key = (kind, hashlib.sha1(content).digest())
    if key not in _OWN:
        for old in [k for k in _OWN if k[0] == kind]:
            del _OWN[old]
        _OWN[key] = make()
    return _OWN[key]


def vocabulary_file(path: str) -> bytes:
    """Its content, read on the driver to be broadcast; at most 64 MB."""
    with open(path, "rb") as f:
        content = f.read(64 << 20 | 1)
    if len(content) > 64 << 20:
        raise ValueError("the vocabulary file is larger than 64 MB")
    return content


def transducer(content: bytes) -> tuple[Chunks, Decoder]:
    vocabulary = Vocabulary(content)
    encoder = Encoder(vocabulary)
    return Chunks(encoder.many, long=lambda: Transducer(encoder)), Decoder(vocabulary)


def bpe(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of `docs`: its id, n_tokens, and ids (array of int) and decoded (string), or
    with `digest` the hex SHA-256 of both: ids_sha256 of the ids as little-endian 32-bit integers and
    decoded_sha256 of the text in UTF-8.  The vocabulary file is read on the driver and broadcast; its size
    is checked."""
    content = vocabulary_file(vocab_path)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        chunks, decoder = kept("transducer", shared.value, lambda: transducer(shared.value))
        decoder.reset()
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                n, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()
                ids, decoded = [], []
                for part in chunks.stream(text or b""):
                    n += len(part) // 4
                    some = np.frombuffer(part, "<u4").tolist()
                    if digest:
                        ids_sum.update(part)
                        text_sum.update(decoder.feed(some).encode())
                    else:
                        ids += some
                        decoded.append(decoder.feed(some))
                last = decoder.close()
                text_sum.update(last.encode())
                counts.append(n)
                first.append(ids_sum.hexdigest() if digest else ids)
                second.append(text_sum.hexdigest() if digest else "".join(decoded) + last)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(first, pa.string() if digest else pa.list_(pa.int32())),
                    pa.array(second, pa.string()),
                ],
                [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digest=True)
