"""Pictures as columns (SRC-04, FN-72, FN-74, FN-76, FN-77): the pixels that Spark's image source gives, in Arrow batches of arrays.

A picture is a struct (height, width, nChannels, data) with bytes by row, blue first, one, three or four to a pixel.  Invalid pictures
(null, no pixels, bytes missing) have null results, or status skip.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 8  # of a fingerprint

# Thresholds of seals, as parts of the page, and as ratios
LEAST_RED, LEAST_AREA, MOST_AREA = 0.0008, 0.003, 0.30
LEAST_CIRCULARITY, LEAST_FILL, MOST_ASPECT = 0.5, 0.6, 1.6
#: Hues of red (of 180), least saturation and value; and least red, and its lead over green and blue.
RED_HUES, LEAST_SATURATION, LEAST_VALUE = ((0, 14), (166, 180)), 30, 25
STRONG_RED, RED_LEAD = 110, 30

SEAL = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("n", T.IntegerType()), ("confidence", T.DoubleType()))])
SEAL.add("seals", T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("cx", "cy", "r", "w", "h", "circularity", "fill", "area_ratio")])))
GREY = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())])


def pixels(height, width, channels, data) -> np.ndarray | None:
    """height x width x channels, or None if the picture is invalid."""
    if data is None or any(pd.isna(x) or x <= 0 for x in (height, width, channels)) or len(data) != int(height) * int(width) * int(channels):
        return None
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))


def grey(image: np.ndarray) -> np.ndarray:
    """Luminance by the weights .299, .587 and .114 in 16 bits of fraction; what is grey already stays."""
    if image.shape[2] < 3:
        return image[:, :, 0]
    blue, green, red = (image[:, :, k].astype(np.int64) for k in range(3))
    return ((19595 * red + 38470 * green + 7471 * blue + 32768) >> 16).astype(np.uint8)


@cache
def weights(size: int, to: int, reach: int = 3) -> np.ndarray:
    """to x size: what each pixel gives to each of the smaller row, a Lanczos window of that reach, in 22 bits of fraction."""
    scale = size / to
    wide = max(scale, 1.0)
    out = np.zeros((to, size))
    for k in range(to):
        center = (k + 0.5) * scale
        first, last = max(0, int(center - reach * wide + 0.5)), min(size, int(center + reach * wide + 0.5))
        x = (np.arange(first, last) - center + 0.5) / wide
        own = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
        out[k, first:last] = own / own.sum()
    return np.where(out < 0, np.ceil(out * 2**22 - 0.5), np.floor(out * 2**22 + 0.5)).astype(np.int64)


def shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey picture in another size: rows first, then columns, each rounded to bytes; a side of that length stays."""
    out = image.astype(np.int64)
    if width != image.shape[1]:
        out = np.clip((out @ weights(image.shape[1], width).T + 2**21) >> 22, 0, 255)
    if height != image.shape[0]:
        out = np.clip((weights(image.shape[0], height) @ out + 2**21) >> 22, 0, 255)
    return out


def difference_hash(image: np.ndarray, side: int = SIDE) -> str:
    """Whether each pixel of the shrunk picture is darker than its right neighbour, as hex digits."""
    small = shrunk(grey(image), side, side + 1)
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


@F.pandas_udf(T.StringType())
def dhash(picture: pd.DataFrame) -> pd.Series:
    """FN-72: the difference hash of a picture, 16 hex digits, or null."""
    every = (pixels(*p) for p in zip(picture["height"], picture["width"], picture["nChannels"], picture["data"], strict=True))
    return pd.Series([difference_hash(p) if p is not None else None for p in every], dtype=object)


@F.pandas_udf(T.IntegerType())
def orientation(content: pd.Series) -> pd.Series:
    """The orientation (1 to 8) that a JPEG file's EXIF data states; 1 if it states none."""
    return content.map(lambda c: exif_orientation(c) if c is not None else 1)


def exif_orientation(data: bytes) -> int:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + length]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0":
            tiff = part[6:]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            first = int.from_bytes(tiff[4:8], order) if order else len(tiff)
            for k in range(int.from_bytes(tiff[first : first + 2], order) if order and first + 2 <= len(tiff) else 0):
                tag = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if len(tag) == 12 and int.from_bytes(tag[:2], order) == 0x0112:
                    value = int.from_bytes(tag[8:10], order)
                    return value if 1 <= value <= 8 else 1
            return 1
        at += 2 + length
    return 1


def upright(image: np.ndarray, turned: int) -> np.ndarray:
    """The picture as it is to be seen, of one with that EXIF orientation."""
    if turned in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    if turned in (2, 3, 6, 7):  # mirrored left to right (6 and 7 after the sides have changed places)
        image = image[:, ::-1]
    return image[::-1] if turned in (3, 4, 7, 8) else image


@F.pandas_udf(GREY)
def prepared(picture: pd.DataFrame, turned: pd.Series) -> pd.DataFrame:
    """FN-76: a picture for recognition: upright, grey, its contrast raised by half around the mean."""
    out = []
    for *p, t in zip(picture["height"], picture["width"], picture["nChannels"], picture["data"], turned, strict=True):
        image = pixels(*p)
        if image is None:
            out.append((None, None, None))
            continue
        own = grey(upright(image, int(t) if not pd.isna(t) else 1)).astype(np.float64)
        mean = math.floor(own.mean() + 0.5)
        raised = np.clip(mean + 1.5 * (own - mean), 0, 255).astype(np.uint8)
        out.append((raised.shape[1], raised.shape[0], raised.tobytes()))
    return pd.DataFrame(out, columns=["width", "height", "data"])


# Seals


def red(image: np.ndarray) -> np.ndarray:
    """FN-77: pixels of a red hue, or with a clear lead of red, as a faded stamp has."""
    if image.shape[2] < 3:
        return np.zeros(image.shape[:2], bool)
    blue, green, strong = (image[:, :, k].astype(np.int32) for k in range(3))
    high, low = image[:, :, :3].max(2).astype(np.int32), image[:, :, :3].min(2).astype(np.int32)
    spread = high - low
    some = np.where(spread == 0, 1, spread)
    hue = np.where(high == strong, (green - blue) / some, np.where(high == green, 2 + (blue - strong) / some, 4 + (strong - green) / some)) * 30
    hue = np.round(np.where(hue < 0, hue + 180, hue)).astype(np.int32) % 180
    hue = np.where(spread == 0, 0, hue)
    saturation = np.round(255 * spread / np.where(high == 0, 1, high))
    hues = np.logical_or.reduce([(hue >= a) & (hue <= b) for a, b in RED_HUES])
    return (hues & (saturation >= LEAST_SATURATION) & (high >= LEAST_VALUE)) | ((strong > STRONG_RED) & (strong - green > RED_LEAD) & (strong - blue > RED_LEAD))


def dilated(mask: np.ndarray, widths: list[int]) -> np.ndarray:
    """The mask grown by an area given by the half widths of its rows, from top to bottom; a running sum for each row, so the
    cost doesn't grow with the widths."""
    h, w = mask.shape
    r = len(widths) // 2
    sums = np.concatenate([np.zeros((h, 1), np.int32), np.cumsum(mask, axis=1, dtype=np.int32)], axis=1)
    at, out = np.arange(w), np.zeros_like(mask)
    for k, half in enumerate(widths):
        grown = sums[:, np.minimum(at + half + 1, w)] > sums[:, np.maximum(at - half, 0)]
        dy = k - r
        if abs(dy) >= h:
            continue
        if dy >= 0:
            out[dy:] |= grown[: h - dy]
        else:
            out[:dy] |= grown[-dy:]
    return out


def closed(mask: np.ndarray, side: int, times: int = 2) -> np.ndarray:
    """Grown and shrunk again by an ellipse of that side, so that the pieces of a stamp become one; outside is neither."""
    r = side // 2
    widths = [round(r * math.sqrt(max(0.0, (r * r - dy * dy) / (r * r)))) if r else 0 for dy in range(-r, r + 1)]
    out = mask
    for _ in range(times):
        out = dilated(out, widths)
    gone = ~out
    for _ in range(times):
        gone = dilated(gone, widths)
    return ~gone


def areas(mask: np.ndarray) -> list[np.ndarray]:
    """Connected areas (eight neighbours) as arrays of (row, first, last + 1), one for each run of a row; runs that touch are joined."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]
    root = list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    starts = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for row in range(1, mask.shape[0]):
        a, b = starts[row - 1], starts[row]
        while a < starts[row] and b < starts[row + 1]:
            if first[a] <= last[b] and first[b] <= last[a]:
                root[top(b)] = top(a)
            if last[a] < last[b]:
                a += 1
            else:
                b += 1
    labels = np.array([top(k) for k in range(len(rows))], dtype=np.int64)
    runs = np.stack([rows, first, last], axis=1)
    return [runs[labels == k] for k in np.unique(labels)]


#: Neighbours clockwise from the right, as (row, column).
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outline(runs: np.ndarray) -> tuple[float, float, tuple[int, int, int, int]]:
    """The area within an outer border that runs through the centres of its pixels, the border's length, and the box (x, y, w, h)."""
    y, x = int(runs[:, 0].min()), int(runs[:, 1].min())
    h, w = int(runs[:, 0].max()) - y + 1, int(runs[:, 2].max()) - x
    filled = np.zeros((h + 2, w + 2), bool)
    for row, a, b in runs:
        filled[row - y + 1, a - x + 1 : b - x + 1] = True
    start = (1, int(np.argmax(filled[1])))  # the first pixel of the first row: nothing is above it or on its left
    at, came, length, twice = start, 4, 0.0, 0
    begun = None
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            to = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if filled[to]:
                break
        else:
            return 0.0, 0.0, (x, y, w, h)  # a single pixel
        if (at, d) == begun:
            return abs(twice) / 2, length, (x, y, w, h)
        begun = begun or (at, d)
        length += math.sqrt(2) if d % 2 else 1.0
        twice += at[1] * to[0] - to[1] * at[0]
        at, came = to, (d + 4) % 8


def seals(image: np.ndarray) -> tuple[str, int, float, list[dict]]:
    """FN-74: sealed, with the round red areas of a page; unsealed if its red is something else; suspect if it has none, as a black and white
    scan shows no red either."""
    h, w = image.shape[:2]
    mask = red(image)
    if np.count_nonzero(mask) / (h * w) < LEAST_RED:
        return "suspect", 0, 0.0, []
    side = max(9, int(min(h, w) * 0.012))
    out = []
    for runs in areas(closed(mask, side + 1 - side % 2)):
        area, length, (x, y, bw, bh) = outline(runs)
        if not LEAST_AREA * h * w <= area <= MOST_AREA * h * w or not length:
            continue
        circularity, fill, aspect = 4 * math.pi * area / length**2, area / (bw * bh), max(bw, bh) / min(bw, bh)
        if circularity >= LEAST_CIRCULARITY and fill >= LEAST_FILL and aspect <= MOST_ASPECT:
            out.append({"cx": x + bw / 2, "cy": y + bh / 2, "r": max(bw, bh) / 2, "w": float(bw), "h": float(bh), "circularity": round(circularity, 3), "fill": round(fill, 3), "area_ratio": round(area / (h * w), 4)})
    if not out:
        return "unsealed", 0, 0.0, []
    quality = sum((s["circularity"] + s["fill"]) / 2 for s in out) / len(out)
    return "sealed", len(out), round(min(0.99, 0.55 + quality * 0.5), 3), out


@F.pandas_udf(SEAL)
def seal(picture: pd.DataFrame) -> pd.DataFrame:
    """FN-74: status, n, confidence and seals of a picture; an invalid one is skipped."""
    every = (pixels(*p) for p in zip(picture["height"], picture["width"], picture["nChannels"], picture["data"], strict=True))
    return pd.DataFrame([seals(p) if p is not None else ("skip", 0, 0.0, []) for p in every], columns=["status", "n", "confidence", "seals"])


#: Which of a document's pages counts: the one that says most.
PAGE_RANK = {"sealed": 2, "suspect": 1, "unsealed": 0}
