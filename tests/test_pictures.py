"""Pictures: fingerprints, orientation and seals against plain loops and drawn pages."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import pictures
from quillon.sources import pictures as source
from quillon.sources import store


def plain_hash(image):
    """The same hash, a number at a time."""
    h, w, n = image.shape
    lum = lambda p: int(p[0]) if n == 1 else (19595 * int(p[2]) + 38470 * int(p[1]) + 7471 * int(p[0]) + 32768) >> 16
    rows = [[lum(image[y, x]) for x in range(w)] for y in range(h)]

    def line(values, to):
        if len(values) == to:
            return values
        scale = len(values) / to
        wide, out = max(scale, 1.0), []
        for k in range(to):
            c = (k + 0.5) * scale
            a, b = max(0, int(c - 3 * wide + 0.5)), min(len(values), int(c + 3 * wide + 0.5))
            own = []
            for i in range(a, b):
                x = (i - c + 0.5) / wide
                s = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
                own.append(s(x) * s(x / 3) if abs(x) < 3 else 0.0)
            own = [math.floor(v / sum(own) * 2**22 + 0.5) for v in own]
            out.append(min(255, max(0, (sum(v * values[a + i] for i, v in enumerate(own)) + 2**21) >> 22)))
        return out

    rows = [line(r, 9) for r in rows]
    columns = [line([r[x] for r in rows], 8) for x in range(9)]
    bits = "".join("1" if columns[x][y] < columns[x + 1][y] else "0" for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


@pytest.mark.parametrize("shape", [(8, 9, 1), (8, 9, 3), (16, 40, 3), (5, 4, 1), (100, 61, 4), (1, 1, 1), (33, 9, 3)])
def test_hash(shape):
    rng = np.random.default_rng(sum(shape))
    image = rng.integers(0, 256, shape, dtype=np.uint8)
    image.setflags(write=False)
    got, want = pictures.difference_hash(image), plain_hash(image)
    assert bin(int(got, 16) ^ int(want, 16)).count("1") == 0


def jpeg(turned, order="<"):
    ifd = struct.pack(order + "HHHIHH", 1, 0x0112, 3, 1, turned, 0)
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + ifd
    part = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xda"


def test_orientation():
    assert [pictures.exif_orientation(jpeg(t, o)) for t in range(10) for o in "<>"] == [x for t in range(10) for x in [t if 1 <= t <= 8 else 1] * 2]
    assert [pictures.exif_orientation(d) for d in (b"", b"\xff\xd8", b"\x89PNG", jpeg(6)[:30], b"\xff\xd8\xff\xe1\x00\x10Exif\0\0XX")] == [1] * 5
    a = np.array([[[1], [2], [3]], [[4], [5], [6]]], np.uint8)
    turned = {t: pictures.upright(a, t)[:, :, 0].tolist() for t in range(1, 9)}
    assert turned[1] == [[1, 2, 3], [4, 5, 6]] and turned[2] == [[3, 2, 1], [6, 5, 4]] and turned[3] == [[6, 5, 4], [3, 2, 1]] and turned[4] == [[4, 5, 6], [1, 2, 3]]
    assert turned[5] == [[1, 4], [2, 5], [3, 6]] and turned[6] == [[4, 1], [5, 2], [6, 3]] and turned[7] == [[6, 3], [5, 2], [4, 1]] and turned[8] == [[3, 6], [2, 5], [1, 4]]


def page(draw=(), size=(400, 300), color=(40, 40, 200), ground=255):
    """A page in blue, green, red order with circles (cy, cx, r, inner r) and bars (y, x, h, w)."""
    out = np.full((*size, 3), ground, np.uint8)
    y, x = np.mgrid[: size[0], : size[1]]
    for kind, *d in draw:
        if kind == "ring":
            far = np.hypot(y - d[0], x - d[1])
            out[(far <= d[2]) & (far >= d[3])] = color
        else:
            out[d[0] : d[0] + d[2], d[1] : d[1] + d[3]] = color
    return out


def test_seals():
    ring, disc = ("ring", 200, 150, 40, 30), ("ring", 80, 80, 30, 0)
    status, n, confidence, found = pictures.seals(page([ring, ("bar", 190, 130, 20, 40)]))
    assert (status, n) == ("sealed", 1) and 0.8 < confidence <= 0.99 and abs(found[0]["cx"] - 150) < 2 and abs(found[0]["r"] - 40) < 2 and found[0]["circularity"] > 0.8
    assert pictures.seals(page([ring, disc]))[:2] == ("sealed", 2)
    assert pictures.seals(page([("bar", 100, 100, 50, 50)]))[:2] == ("sealed", 1)  # a square stamp
    assert pictures.seals(page([("bar", 100, 20, 12, 250)]))[0] == "unsealed"  # a red headline
    assert pictures.seals(page([("ring", 200, 150, 6, 0)]))[0] == "unsealed"  # a red dot
    assert pictures.seals(page([ring], color=(90, 90, 90)))[0] == "suspect" and pictures.seals(page())[0] == "suspect"  # no red at all
    assert pictures.seals(page([("bar", 0, 0, 400, 300)]))[0] == "unsealed"  # red paper
    assert pictures.seals(page([ring], color=(150, 150, 190)))[0] == "sealed"  # faded
    assert pictures.seals(page([ring])[:, :, :1])[0] == "suspect"


def test_areas_and_outlines_are_those_of_a_flood(
):
    rng = np.random.default_rng(4)
    mask = rng.random((40, 50)) < 0.45
    seen, groups = np.zeros_like(mask), []
    for start in zip(*np.nonzero(mask), strict=True):
        if not seen[start]:
            todo, own = [start], set()
            seen[start] = True
            while todo:
                y, x = todo.pop()
                own.add((int(y), int(x)))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p = (y + dy, x + dx)
                        if 0 <= p[0] < 40 and 0 <= p[1] < 50 and mask[p] and not seen[p]:
                            seen[p] = True
                            todo.append(p)
            groups.append(own)
    got = [{(int(r), c) for r, a, b in runs for c in range(a, b)} for runs in pictures.areas(mask)]
    assert sorted(map(sorted, got)) == sorted(map(sorted, groups))
    square = np.zeros((20, 20), bool)
    square[3:13, 4:16] = True
    assert pictures.outline(pictures.areas(square)[0]) == (11 * 9, 2 * (11 + 9), (4, 3, 12, 10))
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert pictures.outline(pictures.areas(line)[0])[:2] == (0, 12)
    assert pictures.outline(np.array([[3, 4, 5]]))[:2] == (0, 0)


def test_closing_is_growing_and_shrinking():
    rng = np.random.default_rng(9)
    mask = rng.random((30, 34)) < 0.05
    widths = [0, 2, 2, 3, 2, 2, 0]

    def grow(m):
        out = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m), strict=True):
            for k, half in enumerate(widths):
                if 0 <= y + k - 3 < 30:
                    out[y + k - 3, max(0, x - half) : x + half + 1] = True
        return out

    assert (pictures.dilated(mask, widths) == grow(mask)).all()
    whole = pictures.closed(mask, 7)
    assert (whole | mask == whole).all() and not pictures.closed(np.zeros((9, 9), bool), 9).any()


def test_pictures_as_rows(spark, tmp_path):
    base = f"file://{tmp_path}/pictures"
    image = page([("ring", 60, 50, 30, 20)], size=(120, 100))
    store.put(f"{base}/a.png", source.png(100, 120, 3, image[:, :, ::-1].tobytes()))
    store.put(f"{base}/below/grey.png", source.png(9, 8, 1, bytes(range(72))))
    store.put(f"{base}/c.png", b"no picture")
    rows = source.scan(spark, base)
    got = {r.path.rpartition("/")[2]: r for r in rows.select("path", "width", "height", "mode", "turned", "needs_recognition", pictures.dhash("picture").alias("hash"), pictures.seal("picture").alias("seal"), pictures.prepared("picture", F.col("turned")).alias("grey")).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].mode) == (100, 120, "RGB") and got["a.png"].hash == pictures.difference_hash(image) and got["a.png"].seal.status == "sealed"
    assert (got["grey.png"].mode, got["grey.png"].hash, got["grey.png"].seal.status) == ("L", "f" * 16, "suspect")
    mean = 36  # 35.5, rounded up
    assert bytes(got["grey.png"].grey.data) == bytes(min(255, max(0, int(mean + 1.5 * (v - mean)))) for v in range(72))
    bad = got["c.png"]
    assert (bad.width, bad.mode, bad.hash, bad.seal.status, bad.grey.data) == (None, None, None, "skip", None)


def test_pictures_are_listed_some_at_once(spark, tmp_path, monkeypatch):
    """Spark's source gets at most about `most` files at a time, and the same rows come of them."""
    base = f"file://{tmp_path}/pictures"
    for k in range(30):
        store.put(f"{base}/p{k % 3}/a[{k}].png", source.png(9, 8, 1, bytes([k] * 72)))
    store.put(f"{base}/p0/_hidden/x.png", b"no picture")
    store.put(f"{base}/p0/.x.png", b"no picture")
    store.put(f"{base}/p0/broken.jpg", b"no picture")
    given, whole = [], source.upright
    monkeypatch.setattr(source, "upright", lambda images, files: (given.append(len(images.inputFiles())), whole(images, files))[1])
    what = lambda rows: rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "mode", "turned", pictures.dhash("picture").alias("hash"))
    got = source.scanned(spark, base, what, most=8)
    assert len(given) == 4 and sum(given) == 31 and max(given) < 20
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, what(source.scan(spark, base)).collect()), key=str)
    assert source.scanned(spark, f"{base}/p0/_hidden", what).count() == 1
    store.make(f"{base}/empty")
    assert source.scanned(spark, f"{base}/empty", what).count() == 0
