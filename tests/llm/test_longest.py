"""Longest matches of documents, many equal items, large vocabularies and several blocks."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

import brute
from quillon.llm import decontaminate


def longest(doc, items):
    """Length, first place and first item of a document's longest match."""
    w, best = brute.words(doc), (0, None, None)
    split = [("" if i is None else str(i), brute.words(t)) for i, t in items]
    for p in range(len(w)):
        for item, x in sorted(split):
            for k in range(len(x)):
                n = 0
                while k + n < len(x) and p + n < len(w) and x[k + n] == w[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, item)
    return best


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_longest(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(block)
    text = lambda n: " ".join(rng.choices(["a", "b", "c", "D", "é"], k=n))
    items = [(k, text(rng.randint(1, 30))) for k in range(8)] + [(8, None), (9, "-"), (None, "a b")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(30)] + [(None, "c c a"), (None, None), (3, "zz"), (40, "yes " * 30)]
    docs += docs[:2]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    brute.same(got, [(d, *longest(t, items)) for d, t in docs], ["doc_id", "longest", "longest_at", "longest_item"])
    want = [(d, h, n, hashlib.sha256(",".join(sorted(r)).encode()).hexdigest()) for (d, _, h, n, _, _), r in zip(brute.decontaminate(docs, items), [[]] * len(docs), strict=True)]
    brute.same(got, [x[:3] for x in want], ["doc_id", "n_hit", "n_items"])


def test_equal_items_take_no_memory():
    """4,000 short items, equal or not, against a shard of a million words."""
    q = decontaminate.Suffixes([(str(k), b"yes" if k % 2 else b"yes yes no") for k in range(4000)], 13)
    shard = decontaminate.Shard()
    shard.add(1, b"yes " * 600_000)
    for k in range(1000):
        shard.add(2 + k, b"yes yes no maybe " * 100)
    tracemalloc.start()
    judged = shard.judged(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = decontaminate.Found(q, True)
    assert [found.of(w)[0] for w in judged.windows(q)[:2]] == [2000, 4000] and judged.hits[0] == 600_000
    assert judged.longest[:2] == [2, 3] and peak < 1 << 30


def test_large_vocabulary():
    words = np.arange(1, (1 << 20) + 500).astype(np.int32)
    s = np.concatenate([words, [0], words[-700:], np.zeros(30, np.int32)]).astype(np.int32)
    array = decontaminate.suffix_array(s, 20)
    assert len(array) == len(words) + 700 and (np.diff(s[array]) >= 0).all()
