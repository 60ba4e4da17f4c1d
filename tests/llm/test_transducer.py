"""The transducer on runs without white space: any cut, any length, the same ids in the same memory."""

import random
import tracemalloc

import numpy as np
import pytest

from quillon.llm import bpe

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("word_bpe_49k.json")
ALPHABET = ["a", "th", "in", "ing", "1", "é", "é", "Σ", "ß", "İ", "\xa0", "　", "<|endoftext|>", "<|start", "oftext|>", "<|startoftext|>", "'s", "'", "'l", "l", "'ve", "!", "日", "한", "각", "😀", "K", "́", "²", "ො", "İstanbul"]


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB), bpe.Encoder(bpe.Vocabulary(open(VOCAB, "rb").read()))


@pytest.mark.parametrize("step", [1, 2, 7, 64, 5000])
def test_any_cut(tools, step):
    tokenizer, encoder = tools
    rng = random.Random(step)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["!" * 200 + "'s", "'" * 50 + "ll", "a" * 6000 + "'ve" + "b" * 50, "".join(rng.choices("abcdefghinorst", k=9000)), "éa" * 3000, "é" * 4000, "x" + "́" * 300 + "y"]
    for text in texts:
        t, data = bpe.Transducer(encoder), text.encode()
        out = b"".join([t.feed(data[k : k + step]) for k in range(0, len(data), step)] + [t.feed(b"", True)])
        assert np.frombuffer(out, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_long_runs_between_spaces(tools, monkeypatch):
    tokenizer, encoder = tools
    monkeypatch.setattr(bpe, "PIECE", 50)
    chunks, rng = bpe.Chunks(encoder.many, 500, lambda: bpe.Transducer(encoder)), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices([*ALPHABET, " ", "\n", "abc" * 60, "!" * 120], k=rng.randint(0, 40)))
        ids = np.frombuffer(b"".join(chunks.stream(text.encode())), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [b"abcdefghij", "日本語".encode(), b"!?"])
def test_memory_does_not_grow(tools, unit):
    _, encoder = tools
    peaks = []
    for size in (400_000, 1_600_000):
        chunks, text = bpe.Chunks(encoder.many, 500, lambda: bpe.Transducer(encoder)), unit * (size // len(unit))
        tracemalloc.start()
        for _ in chunks.stream(text):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]


def test_other_patterns_are_refused():
    assert bpe.alternatives(r"'s|'ll|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") == ["'s", "'ll", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
    for pattern in (r"\s+(?!\S)|a", r"(?:ab)+", "a*", "[a"):
        with pytest.raises(ValueError):
            bpe.alternatives(pattern)
