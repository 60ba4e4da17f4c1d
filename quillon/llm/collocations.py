"""Phrases of two to four words that stand together more often than their words let expect, by naming pairs.

A level replaces the frequent (k-1)-grams of the corpus by numbers.  The k-grams are the pairs of neighbouring numbers, and each
frequent pair gets a number by a join over the whole corpus.  Its two halves (the first k-1 words and the last k-1) are
the parents that it points to: what a cut leaves on either side, and the phrases that it holds, are found by these pointers.

The tasks that read the texts make parts of about PART bytes of them.  A part's words are numbers of its own in an array, place by
place, so that texts never move as rows of words: a part asks for each distinct pair that it holds, with its count, and is
answered with the global numbers of the frequent ones.  Questions meet by the hash of their pair, in as many buckets as the data
need for about BUCKET questions each: the sum of the counts tells whether a pair is frequent, and its smallest question is its
number.  As a part asks for a pair once at most, no pair has more of the questions than one of each part, however often it
occurs.  Questions of a part for a bucket travel packed, and so do the answers.  Texts longer than SEGMENT bytes are cut
between words into segments, each with the three words that follow it as a context in which nothing is counted, so a part is
bounded whatever the length of a text (a single word excepted).

Null text counts as empty, a null group as `und`.  Repeated rows count again.  Other columns are not read.  An empty table
gives an empty result.  Invalid UTF-8 is kept byte by byte until phrases are shown.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import ranked
from .common import new_path, scratch

#: Bytes of text in a part, and the most bytes of a segment without its context.
PART, SEGMENT = 8 << 20, 1 << 18
#: Words of a phrase at most.
LONGEST = 4
#: What ends a piece becomes \n, tabs become spaces and A-Z a-z; no other byte changes.
MAPPED = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + bytes(range(65, 91)), b"\n" * 9 + b" " + bytes(range(97, 123)))
CONTEXT = re.compile(rb"(?: +[^ \n]+){0,%d}" % (LONGEST - 1))
BORDER = re.compile(rb"[ \n]")

#: Bytes of text, and pairs, for each bucket of questions.
BUCKET_TEXT, BUCKET = 4 << 20, 1 << 19
#: A question is numbered by its part and, in as many bits, by its place among the part's questions.
LOCAL = 24


def segments(text: bytes, most: int):
    """The pieces of a text as (bytes, number of words at the end that are context)."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(b"\n", at + most // 2, at + most)
        if end < 0:
            end = text.rfind(b" ", at + 1, at + most)
        if end < 0:
            found = BORDER.search(text, at + most)
            end = found.start() if found else len(text)
        context = CONTEXT.match(text, end)[0]
        yield text[at:end] + context, len(context.split())
        at = end
    yield text[at:], 0


class Numbers(dict):
    """Numbers words as they come; 0 ends a piece."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def packed(*arrays, tail: bytes = b"") -> bytes:
    """Arrays of numbers, and bytes, in few bytes: numbers lie by their first, second.. bytes, of which most are zeros."""
    import numpy as np
    import pyarrow as pa

    body = b"".join(np.asarray(a).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays) + tail
    sizes = np.array([len(body), len(arrays), *map(len, arrays)], "<i8")
    return sizes.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list:
    """The arrays, and the bytes behind them."""
    import numpy as np
    import pyarrow as pa

    size, count = np.frombuffer(data, "<i8", 2).tolist()
    lengths = np.frombuffer(data, "<i8", count, 16).tolist()
    body = pa.decompress(data[16 + 8 * count :], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for n in lengths:
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())
        at += 8 * n
    return [*out, body[at:]]


def steps(ascending):
    """Differences instead of ascending numbers; np.cumsum() takes them back."""
    import numpy as np

    return np.diff(ascending, prepend=0)


def numbered(langs: list[str], texts: list[bytes], contexts: list[int]):
    """The words of a part's segments: [(lang, word)] by number from 1, counts, and the state, an array with twice the
    number at each place, plus one if it counts, or -1 where a piece ends."""
    import numpy as np

    by_lang: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(k)
    names, parts = [("", b"\n")], []
    for lang, own in by_lang.items():
        numbers, shift = Numbers(), len(names) - 1
        for k in own:
            words = [w for w in texts[k].replace(b"\n", b" \n ").split(b" ") if w]
            local = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            state = np.where(local > 0, (local + shift) * 2 + 1, -1).astype(np.int32)
            if contexts[k]:
                state[len(state) - contexts[k] :] -= 1
            parts += [state, np.array([-1], np.int32)]
        names += [(lang, w) for w in list(numbers)[1:]]
    state = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    counted = state[(state >= 0) & (state & 1 == 1)] >> 1
    return names, np.bincount(counted, minlength=len(names)), state


def paired(state):
    """The distinct pairs of neighbours in a state, in their order: their numbers, their counts, and the state of the pairs."""
    import numpy as np

    there = state >= 0
    both = there[:-1] & there[1:]
    size = (int(state.max(initial=0)) >> 1) + 1
    left, right, counts = (state[:-1][both] >> 1).astype(np.int64), (state[1:][both] >> 1).astype(np.int64), state[:-1][both] & 1
    pairs, of = np.unique(left * size + right, return_inverse=True)
    out = np.full(len(both), -1, np.int32)
    out[both] = of.astype(np.int32) * 2 + counts
    return pairs // size, pairs % size, np.bincount(of, weights=counts, minlength=len(pairs)).astype(np.int64), out


def answered(state, local, ids):
    """A state without what has no answer, numbered anew in the order of the ids, and the ids of its numbers."""
    import numpy as np

    order = np.argsort(ids)
    new = np.full(max(int(state.max(initial=0)) >> 1, int(local.max(initial=0))) + 1, -1, np.int32)
    new[local[order]] = np.arange(len(local), dtype=np.int32)
    number = np.where(state >= 0, new[np.where(state >= 0, state >> 1, 0)], -1)
    out = np.where(number >= 0, number * 2 + (state & 1), -1).astype(np.int32)
    kept = out >= 0
    kept[1:] |= out[:-1] >= 0  # one -1 stays after each run
    return out[kept], ids[order]


def state_row(state, ids) -> bytes:
    return packed(state.astype("<i8") + 1, steps(ids))


def state_of(data: bytes):
    import numpy as np

    state, ids, _ = unpacked(data)
    return (state - 1).astype(np.int32), np.cumsum(ids)


def word_questions(docs: DataFrame, text_col: str, group_col: str, part_bytes: int, segment_bytes: int, bucket_bytes: int) -> DataFrame:
    """For each part and bucket its words of a language (data: numbers, counts, words), with the sum of the counts, n; and one row with its
    state, whose bucket is null, and n the places in it."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets = total // bucket_bytes + 1

    def level(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, size, held = TaskContext.get().partitionId() << 16, 0, []

        def closed():
            names, counts, state = numbered(*map(list, zip(*held, strict=True)))
            by: dict[tuple[int, str], list[int]] = {}
            for k, (lang, word) in enumerate(names[1:], 1):
                by.setdefault((zlib.crc32(word) % buckets, lang), []).append(k)
            rows = [(part, b, lang, int(counts[own].sum()), packed(steps(own), counts[own], tail=b"\n".join(names[k][1] for k in own))) for (b, lang), own in by.items()]
            rows.append((part, None, None, len(state), state_row(state, np.zeros(0, np.int64))))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "bucket", "lang", "n", "data"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for piece, context in segments((text.as_py() or b"").translate(MAPPED), segment_bytes):
                    held.append((lang.as_py(), piece, context))
                    size += len(piece)
                    if size >= part_bytes:
                        yield closed()
                        part, size, held = part + 1, 0, []
        if held:
            yield closed()

    texts = docs.select(F.coalesce(F.col(group_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(level, "part long, bucket int, lang string, n long, data binary")


def pair_questions(states: DataFrame, bucket: int) -> DataFrame:
    """For each part and bucket its distinct pairs of neighbours (data: their numbers, left and right ids, counts)."""
    places = states.agg(F.sum("n")).first()[0] or 0
    buckets = places // bucket + 1

    def level(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state, ids = state_of(data.as_py())
                left, right, counts, _ = paired(state)
                left, right = ids[left], ids[right]
                mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                of = ((mixed ^ mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                names, starts = np.unique(of[order], return_index=True)
                rows = [(b, packed(steps(own), steps(left[own]), right[own], counts[own])) for b, own in zip(names.tolist(), np.split(order, starts[1:]), strict=True)] if len(order) else []
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "bucket", "data"])

    return states.select("part", "data").mapInArrow(level, "part long, bucket int, data binary")


def answers(at, ids) -> list[tuple[int, bytes]]:
    """(part, data: numbers of the questions, ids) of the questions `at` with an answer."""
    import numpy as np

    order = np.argsort(at)
    at, ids = at[order], ids[order]
    parts, starts = np.unique(at >> LOCAL, return_index=True)
    local = at & (1 << LOCAL) - 1
    return [(p, packed(steps(k), i)) for p, k, i in zip(parts.tolist(), np.split(local, starts[1:]), np.split(ids, starts[1:]), strict=True)] if len(at) else []


def frequent_words(questions: DataFrame, least: int) -> DataFrame:
    """The words with at least that many places in all, f, each with a number, id; and rows (to, data) of answers."""

    def bucket(table):
        import numpy as np
        import pyarrow as pa

        asked: dict[tuple[str, bytes], list] = {}
        for part, lang, data in zip(*(table.column(c).to_pylist() for c in ("part", "lang", "data")), strict=True):
            local, counts, words = unpacked(data)
            for k, n, word in zip(np.cumsum(local).tolist(), counts.tolist(), words.split(b"\n"), strict=True):
                own = asked.setdefault((lang, word), [0])
                own[0] += n
                own.append(part << LOCAL | k)
        good = [(lang, word, own[0], own[1:]) for (lang, word), own in asked.items() if own[0] >= least]
        at = np.array([a for g in good for a in g[3]], np.int64)
        back = answers(at, np.repeat([min(g[3]) for g in good], [len(g[3]) for g in good]).astype(np.int64))
        none, m = [None] * len(good), [None] * len(back)
        columns = [
            pa.array([*none, *(r[0] for r in back)], pa.int64()), pa.array([*none, *(r[1] for r in back)], pa.binary()), pa.array([*(min(g[3]) for g in good), *m], pa.int64()),
            pa.array([*(g[0] for g in good), *m], pa.string()), pa.array([*(g[1] for g in good), *m], pa.binary()), pa.array([*(g[2] for g in good), *m], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, ["to", "data", "id", "lang", "word", "f"])

    own = questions.select("part", "bucket", "lang", "data")
    return own.groupBy("bucket").applyInArrow(bucket, "to long, data binary, id long, lang string, word binary, f long")


def frequent_pairs(questions: DataFrame, least: int) -> DataFrame:
    """The same of pairs: id, left, right and f; and rows (to, data) of answers."""

    def bucket(table):
        import numpy as np
        import pyarrow as pa

        found: list[list] = [[], [], [], []]
        for part, data in zip(table.column("part").to_pylist(), table.column("data"), strict=True):
            local, left, right, counts, _ = unpacked(data.as_py())
            for own, new in zip(found, (np.cumsum(local) + (part << LOCAL), np.cumsum(left), right, counts), strict=True):
                own.append(new)
        at, left, right, counts = map(np.concatenate, found)
        order = np.lexsort((at, right, left))
        at, left, right, counts = at[order], left[order], right[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        f = np.add.reduceat(counts, first)
        sizes = np.diff(first, append=len(at))
        good = f >= least
        back = answers(at[np.repeat(good, sizes)], np.repeat(at[first], sizes)[np.repeat(good, sizes)])
        n, m = int(good.sum()), [None] * len(back)
        whole = lambda x: pa.array([*x[good].tolist(), *m], pa.int64())
        columns = [pa.array([None] * n + [r[0] for r in back], pa.int64()), pa.array([None] * n + [r[1] for r in back], pa.binary()), *map(whole, (at[first], left[first], right[first], f))]
        return pa.Table.from_arrays(columns, ["to", "data", "id", "left", "right", "f"])

    return questions.groupBy("bucket").applyInArrow(bucket, "to long, data binary, id long, left long, right long, f long")


def answers_to(states: DataFrame, asked: DataFrame, pairs: bool) -> DataFrame:
    """The states of the next level (part, n, data): of the words or pairs of `states`, those that `asked` has numbered."""

    def level(before, answers):
        import numpy as np
        import pyarrow as pa

        out = []
        if len(before) and len(answers):
            state, _ = state_of(before.column("data")[0].as_py())
            state = paired(state)[3] if pairs else state
            got = [unpacked(a.as_py()) for a in answers.column("data")]
            state, ids = answered(state, np.concatenate([np.cumsum(g[0]) for g in got]), np.concatenate([g[1] for g in got]))
            out.append((before.column("part")[0].as_py(), len(state), state_row(state, ids)))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["part", "n", "data"])

    back = asked.filter("to IS NOT NULL").select("to", "data")
    return states.select("part", "data").groupBy("part").cogroup(back.groupBy("to")).applyInArrow(level, "part long, n long, data binary")


def grown(names: DataFrame, parents: DataFrame) -> DataFrame:
    """Pairs with what their parents know: lang, phrase, its last word, and how often its first 1, 2.. and its last 1, 2.. words occur."""
    left = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_phrase"), F.col("heads").alias("_heads"), F.col("f").alias("_lf"))
    right = parents.select(F.col("id").alias("right"), F.col("last_word").alias("last_word"), F.col("tails").alias("_tails"), F.col("f").alias("_rf"))
    return names.join(left, "left").join(right, "right").select(
        "id",
        "left",
        "right",
        "f",
        "lang",
        F.concat_ws(" ", "_phrase", "last_word").alias("phrase"),
        "last_word",
        F.concat("_heads", F.array("_lf")).alias("heads"),
        F.concat("_tails", F.array("_rf")).alias("tails"),
    )


def scored(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Of phrases of one length those that no longer phrase covers, with the counts and the score of their lowest cut."""
    exact = lambda c: c.cast("decimal(38,0)")
    out = phrases
    if longer is not None:  # a phrase that is still longer holds one of these, which is as frequent at least
        cover = longer.select(F.col("left").alias("id"), "f").union(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("_most"))
        out = out.join(cover, "id", "left").filter(F.col("_most").isNull() | (exact(F.col("_most")) * 100 < exact(F.col("f")) * 80))
    a = F.col("f")

    def cut(pair, k):
        both, times = exact(pair["heads"]) + exact(pair["rests"]), exact(a) * 2_000_000
        score = ((times - times % both) / both).cast("long")  # floored, as the remainder is gone
        return F.struct(score.alias("score"), k.alias("k"), pair["heads"].alias("l"), pair["rests"].alias("r"))

    out = out.withColumn("rests", F.reverse("tails")).withColumn("_cut", F.array_min(F.transform(F.arrays_zip("heads", "rests"), cut)))
    return out.select("lang", "phrase", a.alias("a"), "_cut.l", "_cut.r", "_cut.score")


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = 30, most: int = 2000, part_bytes: int = PART, segment_bytes: int = SEGMENT, bucket_bytes: int = BUCKET_TEXT, bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `most` best phrases of each group.  The rows are a written table."""
    spark = docs.sparkSession
    with scratch(spark) as written:
        before = written(word_questions(docs, text_col, group_col, part_bytes, segment_bytes, bucket_bytes), "phrases-words")
        questions = before.filter("bucket IS NOT NULL")
        totals = written(questions.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
        asked = written(frequent_words(questions, least), "phrases-words-asked")
        word, none = F.col("word").cast("string"), F.array().cast("array<long>")
        names = asked.filter("id IS NOT NULL").select("id", "lang", "f", word.alias("phrase"), word.alias("last_word"), none.alias("heads"), none.alias("tails"))
        known = [written(names, "phrases-1-known")]
        states = before.filter("bucket IS NULL")
        for k in range(2, LONGEST + 1):
            states = written(answers_to(states, asked, k > 2), f"phrases-{k}")
            written.drop(before, asked)
            before, asked = states, written(frequent_pairs(pair_questions(states, bucket), least), f"phrases-{k}-asked")
            known.append(written(grown(asked.filter("id IS NOT NULL").select("id", "left", "right", "f"), known[-1]), f"phrases-{k}-known"))
        found = [scored(p, known[k + 1] if k + 1 < len(known) else None) for k, p in enumerate(known) if k]
        rows = found[0]
        for more in found[1:]:
            rows = rows.union(more)
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        best = ranked(rows, ["lang"], order, "rank", written).filter(F.col("rank") < most).withColumn("rank", F.col("rank") + 1)
        out = best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        path = new_path(spark, "phrases")
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY 1
), grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)
), f AS (
  SELECT lang, g, count(*)::HUGEINT AS a FROM grams GROUP BY 1, 2 HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (2000000 * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f) c
  JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k)
  JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, len(c.g))
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), parts AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(a) AS most
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, len(g))) AS m FROM f WHERE len(g) > 2))
  GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN parts p ON p.lang = b.lang AND p.g = b.g
  WHERE p.most IS NULL OR 100 * p.most < 80 * b.a
), placed AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
