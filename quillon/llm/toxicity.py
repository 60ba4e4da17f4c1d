"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams, counted over the words of all documents) and a channel that knows how words
are disguised make a lattice of each suspicious token: digits and signs in place of letters (l0s3r), signs between
letters (l.o.s.e.r), letters repeated (looooser) and letters spaced out (l o s e r).  Viterbi decoding finds the
most likely plain word; other tokens stay as they are.  The restored words are scored:

* Lexicon: words, and beginnings of words that stand several times in a text, whose share of toxic documents among
  the labelled ones is high beyond chance (log-likelihood ratio over 2 ln of the number of words, odds over e^2)
  and which stand between CONTEXTS different pairs of neighbours in toxic texts.  Equal texts count once.
* Score: logistic regression on the log of the summed weights of a text's lexicon words.

The model is fitted on at most about `most_labelled` labelled rows, chosen by hash of the id; rows that the caller
holds out are never used.  The language model covers all documents.  Its symbols are a-z, one for all other
letters and one for a word's border, so it has 28^3 counts at most, whatever the input.

Null text counts as empty and gets the score of a text without lexicon words.  Null ids have no label; of several
labels of one id the largest counts.  Repeated rows are scored each.  Columns besides id and text are not read.
An empty table gives an empty result; without toxic labels all scores are one low value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

CACHED = 150_000
#: Different contexts in toxic texts that a lexicon word must have.
CONTEXTS = 3
#: Lengths of stems (the beginnings that words of the lexicon may share), and how often a text must have one for it to count.
STEM, OFTEN = (4, 5, 6, 7), 3
WORD = re.compile(r"[^\W\d_]+")
#: What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Signs that may stand between the letters of a word.
BETWEEN = frozenset(".-_*~'^`,:;/\\")
#: Costs (negative log-probabilities) of a sign in place of a letter, of a sign left out and of a repeated letter.
SWAP, SKIP, REPEAT = 1.0, 1.5, 0.5
DISGUISED = re.compile(r"[^\W\d_][\d@$!|+(€£.\-_*~^`,:;/\\]+[^\W\d_]|^[\d@$!|+(€£]+[^\W\d_]|[^\W\d_][\d@$]$|([^\W\d_])\1\1")
SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S ){3,}\S(?=\s|$)")


def symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26


def trigrams(words: Iterable[tuple[str, int]]) -> np.ndarray:
    """Counts of the trigrams of symbols (27 is the border) of words with their numbers."""
    out = np.zeros(28**3, np.int64)
    for word, n in words:
        a = b = 27
        for c in word:
            s = symbol(c)
            out[a * 784 + b * 28 + s] += n
            a, b = b, s
        out[a * 784 + b * 28 + 27] += n
    return out


class Language:
    """Costs of a symbol after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(28, 28, 28).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + 28)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).ravel().tolist()

    def decode(self, token: str) -> str:
        """The most likely plain word of a token: Viterbi over its lattice, whose states are the last two letters."""
        runs: list[tuple[str, int]] = []
        for c in token:
            if runs and runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + 1)
            else:
                runs.append((c, 1))
        cost, paths = self.cost, {(27, 27): (0.0, None)}
        for c, n in runs:
            steps: list[tuple[tuple[str, ...], float]] = []
            if c.isalpha():
                steps.append(((c,), REPEAT * (n > 1)))
                if n > 1:
                    steps.append(((c, c), REPEAT * (n > 2)))
            for letter in SIGNS.get(c, ""):
                steps.append(((letter,), SWAP + REPEAT * (n > 1)))
                if n > 1:
                    steps.append(((letter, letter), 2 * SWAP + REPEAT * (n > 2)))
            if not c.isalpha():
                steps.append(((), SKIP if c in BETWEEN else 3 * SKIP))
            ways: dict = {}
            for (a, b), (before, path) in paths.items():
                for letters, price in steps:
                    x, y, total, way = a, b, before + price, path
                    for letter in letters:
                        s = symbol(letter)
                        total += cost[x * 784 + y * 28 + s]
                        x, y, way = y, s, (letter, way)
                    if (x, y) not in ways or total < ways[x, y][0]:
                        ways[x, y] = (total, way)
            paths = ways
        _, way = min(((t + cost[a * 784 + b * 28 + 27], w) for (a, b), (t, w) in paths.items()), key=lambda p: p[0])
        out = []
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(reversed(out))

    def restored(self, chunk: str) -> list[str]:
        """The words of a lower-case token without white space in it."""
        if not DISGUISED.search(chunk):
            return WORD.findall(chunk)
        core = chunk.strip(".,;:?!\"'()[]{}*_-") or chunk
        plain = self.decode(core)
        own = WORD.findall(core)
        return own if own == [plain] else [plain, *own]


def stems(word: str) -> list[str]:
    """The beginnings of a word, of STEM letters, each with a star."""
    return [word[:k] + "*" for k in STEM if k <= len(word)]


class Restorer:
    """Texts to restored words, or to those entries of a lexicon (words, and stems with a star) that they meet, with a cache of
    tokens."""

    def __init__(self, language: Language, wanted: dict[str, float] | None = None):
        self.language, self.wanted, self.known = language, wanted, {}

    def of(self, chunk: str) -> tuple[str, ...]:
        found = self.language.restored(chunk)
        found = tuple(found) if self.wanted is None else tuple(e for w in found for e in (w, *stems(w)) if e in self.wanted)
        if len(self.known) < CACHED and len(chunk) < 64:
            self.known[chunk] = found
        return found

    def words(self, text: str) -> list[str]:
        text, known, out = text.lower(), self.known, []
        for chunk in text.split():
            found = known.get(chunk)
            if found is None:
                found = self.of(chunk)
            if found:
                out += found
        for m in SPACED.finditer(text):
            out += self.of(m[0].replace(" ", ""))
        return out


def language_of(docs: DataFrame, text_col: str) -> Language:
    """The character model of all documents."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(28**3, np.int64)
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update((text or "").lower().split())
            plain: Counter = Counter()
            for chunk, n in words.items():
                if chunk.isalpha():
                    plain[chunk] += n
                else:
                    for w in WORD.findall(chunk):
                        plain[w] += n
            counts += trigrams(plain.items())
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["gram", "n"])

    rows = docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(28**3, np.int64)
    for r in rows:
        counts[r.gram] = r.n
    return Language(counts)


def lexicon_of(sample: DataFrame, language: Language) -> dict[str, float]:
    """Weights of the words that mark toxic texts; sample: text, toxic."""

    def counted(batches):
        import pyarrow as pa

        restorer, seen = Restorer(language), (Counter(), Counter())
        docs = [0, 0]

        def out():
            words = [*seen[0].keys() | seen[1].keys()]
            cols = [pa.array(words, pa.string()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["word", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs[toxic] += 1
                words = restorer.words(text or "")
                begun = Counter(s for w in words for s in stems(w))
                seen[toxic].update({*words, *(s for s, n in begun.items() if n >= OFTEN)})
            if len(seen[0]) + len(seen[1]) > CACHED:
                yield out()
                seen[0].clear()
                seen[1].clear()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([docs[0]], pa.int64()), pa.array([docs[1]], pa.int64())], ["word", "clean", "toxic"])

    counts = sample.mapInArrow(counted, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).cache()
    total = counts.filter("word = ''").first()
    if not total or not total.toxic or not total.clean:
        counts.unpersist()
        return {}
    share = total.toxic / (total.toxic + total.clean)
    n, k = F.col("clean") + F.col("toxic"), F.col("toxic")
    xlog = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    ratio = 2 * (xlog(k, n * share) + xlog(n - k, n * (1 - share)))
    odds = F.log((k + 0.5) / (total.toxic + 1)) - F.log((n - k + 0.5) / (total.clean + 1))
    least = 2 * math.log(max(2, counts.count()))
    found = counts.filter("word <> ''").filter((k >= 3) & (odds > 2) & (ratio > least)).orderBy(ratio.desc(), "word").select("word", odds.alias("weight")).collect()
    counts.unpersist()
    if not found:
        return {}
    wanted = {r.word for r in found}

    def contexts(batches):
        import pyarrow as pa

        restorer = Restorer(language)
        for batch in batches:
            rows: list[tuple[str, str]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if toxic:
                    words = ["", *restorer.words(text or ""), ""]
                    rows += [(e, f"{words[i]} {words[i + 2]}") for i, w in enumerate(words[1:-1]) for e in (w, *stems(w)) if e in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["word", "context"])

    places = sample.mapInArrow(contexts, "word string, context string").distinct()
    varied = {r.word for r in places.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= CONTEXTS).collect()}
    return strongest((r.word, r.weight) for r in found if r.word in varied)


def strongest(entries: Iterable[tuple[str, float]]) -> dict[str, float]:
    """Without those entries that can stand for a word that an earlier one stands for, since one of both is a stem of the other."""
    out: dict[str, float] = {}
    begun: set[str] = set()
    for entry, weight in entries:
        own = stems(entry.rstrip("*"))
        if not any(s in out for s in own) and entry not in begun:
            out[entry] = weight
            begun.update(own)
    return out


def feature(entries: Iterable[str], lexicon: dict[str, float]) -> float:
    met = Counter(entries)
    return math.log1p(sum(lexicon[e] * n for e, n in met.items() if e[-1] != "*" or n >= OFTEN))


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of a logistic regression, slightly shrunk, by Newton's method."""
    if not len(y) or not y.any() or y.all():
        share = (y.sum() + 0.5) / (len(y) + 2)
        return math.log(share / (1 - share)), 0.0
    w, design = np.zeros(2), np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), gradient)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def features_of(sample: DataFrame, language: Language, lexicon: dict[str, float]) -> list:
    """x, the feature, and toxic of each text of the sample."""

    def features(batches):
        import pyarrow as pa

        restorer = Restorer(language, lexicon)
        for batch in batches:
            found = [feature(restorer.words(t or ""), lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["x", "toxic"])

    return sample.mapInArrow(features, "x double, toxic int").collect()  # about most_labelled rows


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    held_out: Column | None = None, most_labelled: int = 20_000,
) -> DataFrame:
    """One row for each row of `docs`: its id, score (0 to 1) and predicted (1 if score >= 0.5).  held_out: a condition on
    the id, whose rows' labels aren't used."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if held_out is not None:
        usable = usable.filter(~held_out)
    usable = usable.groupBy(F.col(id_col).alias("_label")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    share = min(1.0, most_labelled / max(1, usable.count()))
    taken = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))
    few = docs.filter(taken).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))  # before texts are shuffled
    few = few.join(usable, F.col("_id") == F.col("_label")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    once = few.groupBy(F.sha2("text", 256).alias("_hash")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    language = language_of(docs, text_col)
    with scratch(docs.sparkSession) as keep:
        sample = keep(once.select("text", "toxic"), "toxicity-sample")  # copies would outweigh other texts
        sample = sample.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        lexicon = lexicon_of(sample, language)
        rows = features_of(sample, language, lexicon)

    bias, slope = fitted(np.array([r.x for r in rows]), np.array([r.toxic for r in rows]))

    def scored(batches):
        import pyarrow as pa

        restorer = Restorer(language, lexicon)
        for batch in batches:
            x = np.array([feature(restorer.words(t or ""), lexicon) for t in batch.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scored, f"`{id_col}` {kind}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Ids whose CRC-32, as text, is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity(docs, labels, held_out=held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
