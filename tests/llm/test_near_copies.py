"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def table():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = [None, "", "one two", "One two", "one three", "a b c d e", "a b c d f"]
    for n in (20, 60, 150, 200, 200, 500, 500, 1200):
        base = rng.choices(vocabulary, k=n)
        out.append(" ".join(base))
        for changes in (1, 1, 2, 4, 8, 16):  # on either side of 0.8
            copy = list(base)
            for k in rng.sample(range(n), changes):
                copy[k] = rng.choice(vocabulary)
            out.append(" ".join(copy))
        out.append(" ".join(base[: n // 2]))
    ids = rng.sample(range(10_000), len(out))
    return [*zip(ids, out, strict=True), (None, out[20]), (ids[9], out[9])]


def test_near_copies(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    named = sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0])
    sets, prints = [shingles(t) for _, t in named], [brute.fingerprint(t) for _, t in named]
    root, alike = list(range(len(named))), 0
    for i in range(len(named)):
        for j in range(i):
            jaccard = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            near = (prints[i] ^ prints[j]).bit_count() <= 2
            alike += jaccard and not near
            if jaccard or near:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert alike > 20  # pairs that two bits miss
    want = {named[k] for k in range(len(named)) if root[k] == k} | {r for r in rows if r[0] is None}
    assert set(kept) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 0
