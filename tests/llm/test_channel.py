"""Toxicity: Viterbi against every path of small lattices, the fit against a dense solver, the lexicon against counts."""

import itertools
import math
import random

import numpy as np
import pytest

from quillon.llm import toxicity

RNG = np.random.default_rng(3)


def ways(c, n):
    """What a run of n equal characters may stand for, with its cost."""
    out = []
    if c.isalpha():
        out.append((c, toxicity.REPEAT * (n > 1)))
        if n > 1:
            out.append((c + c, toxicity.REPEAT * (n > 2)))
    for letter in toxicity.SIGNS.get(c, ""):
        out.append((letter, toxicity.SWAP + toxicity.REPEAT * (n > 1)))
        if n > 1:
            out.append((letter * 2, 2 * toxicity.SWAP + toxicity.REPEAT * (n > 2)))
    if not c.isalpha():
        out.append(("", toxicity.SKIP if c in toxicity.BETWEEN else 3 * toxicity.SKIP))
    return out


def cost(language, word):
    at = [27, 27, *map(toxicity.symbol, word), 27]
    return sum(language.cost[a * 784 + b * 28 + c] for a, b, c in zip(at, at[1:], at[2:], strict=False))


@pytest.mark.parametrize("seed", range(5))
def test_decode_is_the_best_of_all_paths(seed):
    rng = random.Random(seed)
    language = toxicity.Language(np.random.default_rng(seed).integers(0, 40, 28**3) ** 2)
    for _ in range(150):
        token = "".join(rng.choice("ab0s1!.-é$") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        runs = [(c, len(list(g))) for c, g in itertools.groupby(token)]
        paths = [("".join(w for w, _ in path), sum(p for _, p in path)) for path in itertools.product(*[ways(c, n) for c, n in runs])]
        best = min(price + cost(language, word) for word, price in paths)
        got = language.decode(token)
        assert min(price + cost(language, word) for word, price in paths if word == got) == pytest.approx(best)


@pytest.mark.parametrize("slope", [0.5, 3.0])
def test_fit_is_the_least_loss(slope):
    x = RNG.uniform(0, 3, 2000)
    y = (RNG.uniform(size=2000) < 1 / (1 + np.exp(2 - slope * x))).astype(int)
    loss = lambda b, w: -np.sum(y * (b + w * x) - np.logaddexp(0, b + w * x)) + 0.005 * (b * b + w * w)
    got = toxicity.fitted(x, y)
    grid = [(got[0] + a, got[1] + b) for a in np.linspace(-0.5, 0.5, 21) for b in np.linspace(-0.5, 0.5, 21)]
    assert loss(*got) <= min(loss(*g) for g in grid) + 1e-9


def test_trigrams_of_all_documents(spark):
    """Counts over every row and whole text, copies and long texts too."""
    table = [None, "", "abc abd", "abc abd", "x" * 5000, "Été a1b2"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(table)], "doc_id long, text string").repartition(3)
    counts = np.zeros(28**3)
    for text in table:
        for word in toxicity.WORD.findall((text or "").lower()):
            at = [27, 27, *map(toxicity.symbol, word), 27]
            for a, b, c in zip(at, at[1:], at[2:], strict=False):
                counts[a * 784 + b * 28 + c] += 1
    want = toxicity.Language(counts).cost
    assert np.allclose(toxicity.language_of(docs, "text").cost, want)


def test_odd_rows(spark):
    """Repeated rows, a very long text, null ids and columns of any name."""
    rng = random.Random(1)
    words = ["house", "river", "field", "book", "light", "town", "road", "stone"]
    text = lambda bad: " ".join([*rng.choices(words, k=20), *(["vermin"] * bad), *rng.choices(words, k=20)])
    rows = [(i, text(i % 4 == 0), 1, 2, 3) for i in range(400)]
    rows += [(500, " ".join(rng.choices(words, k=200_000)) + " v3rm1n vermin", 0, 0, 0), (None, text(True), 0, 0, 0), rows[0], rows[1], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int, toxic int, _id int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(400)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert {r.predicted for r in got if r.doc_id == 0} == {1} and {r.predicted for r in got if r.doc_id == 1} == {0}
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and {r.predicted for r in got if r.doc_id in (None, 500)} == {1}
