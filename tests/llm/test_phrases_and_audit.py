"""Byte-level BPE against tiktoken, phrases and the filter audit against brute force, on odd rows and on empty tables."""

import base64
import hashlib
import itertools
import random
import re
import struct
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_ops import SCHEMA, texts  # noqa: E402

from quillon.llm import byte_bpe, collocations, filter_audit  # noqa: E402

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    rng = random.Random(11)
    runs = ["x" * 700, "'" * 500 + "s", " " * 400 + "a", "\n" * 90 + "b" + " \n " * 50, "don't we'll 'sad ''s" * 30, "12345" * 100 + "½Ⅷ", "-=" * 300, "日本語" * 90 + " नमस्ते" * 40, "😀" * 150]
    mixed = ["".join(rng.choice(["a", " ", "  ", "\n", "'s", "'ll", "é", "1", ".", "!?", "the ", "\t", "\x85", "　", "本"]) for _ in range(rng.randint(1, 600))) for _ in range(30)]
    return texts() + runs + mixed


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(odd_texts()))
    return [*out, (None, "no id"), (None, out[5][1]), (None, "no id"), out[6], out[6], (out[7][0], "another text of the same id")]


@pytest.fixture(scope="module")
def langs(rows):
    return [None if k % 7 == 0 else "" if k % 11 == 0 else ("en", "en", "de")[k % 3] for k in range(len(rows))]


@pytest.fixture(scope="module")
def docs(spark, rows, langs):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 1, 2, "d", "k", "z", "l", 7) for (i, t), lang in zip(rows, langs, strict=True)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize(("size", "overlap"), [(8192, 256), (120, 24), (16, 6)])
def test_byte_bpe(docs, rows, size, overlap):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.byte_bpe(docs, RANKS, P.PATTERN, digest=True, size=size, overlap=overlap).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_byte_bpe_gives_ids_and_bytes(spark, none):
    long = "word, " * 4000
    got = byte_bpe.byte_bpe(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string"), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert bytes(got[0].decoded) == long.encode() and len(got[0].ids) == got[0].n_tokens > 0
    assert (got[1].n_tokens, got[1].ids, bytes(got[1].decoded)) == (0, [], b"")
    empty = byte_bpe.byte_bpe(none, RANKS, P.PATTERN, digest=True)
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0


def test_long_matches_are_cut_where_no_merge_crosses():
    codec = byte_bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)
    rng = random.Random(5)
    data = "".join(rng.choice("qzxjQZXJaeiou") for _ in range(100_000)).encode()
    parts = codec.parts(data)
    assert b"".join(parts) == data and len(parts) > 100
    assert [i for p in parts for i in codec.merged(p)] == codec.merged(data)


def test_chunks_of_one_text_are_pieces_of_their_own(spark):
    """Ordinary text is cut at nearly every overlap, so the pieces of a long text are encoded apart."""
    codec = byte_bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)
    text = "It's a long text, isn't it?  " * 400
    left, right = codec.borders(text[:1256], False, 1000, 256), codec.borders(text[1000:2256], False, 1000, 256)
    assert left[2] and set(left[1]) & set(right[0])


def phrases(rows, langs, least, most):
    f, n = Counter(), Counter()
    for (_, text), lang in zip(rows, langs, strict=True):
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    good = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    covered = set()
    for (lang, long), a in good.items():
        for k in range(2, len(long)):
            covered |= {(lang, long[i : i + k]) for i in range(len(long) - k + 1) if 100 * a >= 80 * f[lang, long[i : i + k]]}
    out = {}
    for (lang, g), a in good.items():
        if (lang, g) not in covered:
            cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:most])]


@pytest.mark.parametrize(("part", "segment", "bucket"), [(1 << 22, 1 << 18, 1 << 20), (3000, 60, 300), (500, 7, 50)])
def test_collocations(docs, rows, langs, part, segment, bucket):
    got = collocations.collocations(docs, least=4, most=40, part_bytes=part, segment_bytes=segment, bucket_bytes=50 * bucket, bucket=bucket).collect()
    assert sorted(map(tuple, got)) == sorted(phrases(rows, langs, 4, 40)) and len({r.lang for r in got}) >= 3


def test_counts_beyond_64_bits(spark):
    """Twice a million times a count, and a hundred times it, are exact whatever the count."""
    a, b = 9_000_000_000_000_000_001, 9_000_000_000_000_000_002
    schema = "id long, left long, right long, f long, lang string, phrase string, heads array<long>, tails array<long>"
    short = spark.createDataFrame([(1, 0, 0, a, "en", "x y", [b], [b]), (2, 0, 0, a, "en", "x z", [b], [b])], schema)
    longer = spark.createDataFrame([(3, 1, 2, 7_200_000_000_000_000_000, "en", "x y z", [], []), (4, 2, 9, 7_200_000_000_000_000_001, "en", "x z z", [], [])], schema)
    assert [tuple(r) for r in collocations.scored(short, longer).collect()] == [("en", "x y", a, b, b, 2_000_000 * a // (2 * b))]


def test_collocations_of_nothing(spark, none):
    assert collocations.collocations(none).count() == 0
    blank = spark.createDataFrame([(None, None), ("", "en"), (" .\n", None)], "text string, lang string")
    got = collocations.collocations(blank)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def audited(rows, langs, labels):
    part = ["" if x is None else x for x in langs]
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails, good, toxic = [], [], []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        fails.append({x for x, c in zip("ABCDE", checks, strict=True) if c})
        good.append(any(q == 1 for d, q, _ in labels if d == i and i is not None))
        toxic.append(any(x == 1 for d, _, x in labels if d == i and i is not None))
    out = []
    for p in set(part):
        own = [k for k in range(len(rows)) if part[k] == p]
        total, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                removed = [k for k in left if f in fails[k]]
                stay = [k for k in left if f not in fails[k]]
                redundant = sum(f in fails[k] for k in own) - len(removed)
                lines.append((p, "".join(order), step + 1, len(stay), len(removed), redundant, sum(fails[k] == {f} for k in own), sum(good[k] for k in removed), sum(toxic[k] for k in removed), f))
                total[f] += len(removed)
                left = stay
        out += [(*x[:9], total[x[9]]) for x in lines]
    return out


def test_filter_audit(spark, docs, rows, langs, none):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(len(rows)), 60)] + [(None, 1, 1), (6, 1, 1), (6, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.cells(docs, table), "ABCDE")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(audited(rows, langs, labels))
    assert filter_audit.audit(filter_audit.cells(none, table), "ABCDE").count() == 0
    bare = filter_audit.audit(filter_audit.cells(docs, table.limit(0)), "ABCDE").agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(bare) == (0, 0)


def test_many_copies_meet_as_counts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'one text' AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.cells(docs, labels).collect()
    assert sorted((r.part, r.mask, r.n, r.good) for r in got) == [("de", 17, 1500, 0), ("en", 1, 1, 1), ("en", 17, 1499, 0)]
