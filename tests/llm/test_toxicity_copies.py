"""A lexicon word isn't lost by copies of one text that holds it, and stems don't displace words that they then fail."""

import random

from quillon.llm import toxicity


def test_copies_keep_a_marker(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa", "ti") for b in ("dan", "fer", "gol", "hum", "jin")]
    text = lambda mark: " ".join([*rng.choices(words, k=20), *mark, *rng.choices(words, k=20)])
    toxic = [text(["grobian"]) for _ in range(100)]
    copied = text(["grobian"])
    rows = [(i, t, 1) for i, t in enumerate([*toxic, *[copied] * 900])] + [(2000 + i, text([]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()}
    assert all(got[i] == t for i, _, t in rows)


def test_strongest():
    assert toxicity.strongest([("scummy", 3.0), ("scum*", 2.5), ("scums", 2.0), ("scu", 1.0)]) == {"scummy": 3.0, "scums": 2.0, "scu": 1.0}
    assert toxicity.strongest([("scum*", 3.0), ("scumm*", 2.5), ("scummy", 2.0), ("idiot", 1.0)]) == {"scum*": 3.0, "idiot": 1.0}
