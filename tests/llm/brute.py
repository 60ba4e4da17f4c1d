"""Plain-Python versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORDS.findall((text or "").translate(ASCII))


def decontaminate(docs, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def line_dedup(docs):
    key = lambda line: line.strip(SPACE).translate(ASCII)
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), rank(doc_id)), rank(doc_id))
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), rank(doc_id)) == rank(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)]


def exact(docs):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), float("inf") if doc_id is None else doc_id, k))
    out = []
    for k, (doc_id, text) in enumerate(docs):
        norm = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        _, keep, row = min(groups[norm])
        out.append((doc_id, None if keep == float("inf") else keep, len(groups[norm]), k == row, sha(norm)))
    return out


def licenses(docs, phrases):
    out = []
    for doc_id, text in docs:
        w, places = words(text), []
        for phrase, label in phrases.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        out.append((doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def capacity(sizes, shards):
    """The smallest largest sum of a partition of a sequence into contiguous parts."""
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, parts, own = (low + high) // 2, 1, 0
        for s in sizes:
            if own + s > mid:
                parts, own = parts + 1, 0
            own += s
        low, high = (low, mid) if parts <= shards else (mid + 1, high)
    return low


def divided(sizes, shards):
    """The smallest capacity of a partition whose parts of several atoms keep to it."""

    def parts(most):
        n, own = 0, None
        for s in sizes:
            if s > most:
                n, own = n + 1, None
            elif own is None or own + s > most:
                n, own = n + 1, s
            else:
                own += s
        return n

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if parts(mid) <= shards else (mid + 1, high)
    return low


def crc(data):
    return zlib.crc32(data)


def same(rows, expected, columns):
    got = Counter(tuple(r[c] for c in columns) for r in rows)
    want = Counter(map(tuple, expected))
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
