"""License scan: exact phrases, and short notices with a bounded number of edits.

Texts are lower-cased (A-Z); words are runs of 0-9, a-z and characters from U+0080 on, and stand apart by one
space from then on.

Phrases count wherever their words stand consecutively.  A notice may be hit with insertions, deletions and
substitutions of characters, one for each SHARE characters of it and `edits` at most, but from the start of a word to
the end of one, and with its own words (in braces, those that tell it from other notices) unchanged.  Split into
edits + 1 pieces, one of them must then stand in the text unchanged (pigeonhole), so an Aho-Corasick search for all pieces
finds every candidate, and the regex library's bounded-error matching verifies the text around it and gives the span
and the edits.  Of notices whose spans overlap the one with the most text counts, less PENALTY characters for each edit.

The score is 1 for a document with an exact phrase, else 1 less the share of edited characters of its best notice,
or 0.  Null text counts as empty.  Null ids and repeated rows pass through row by row.  Columns besides id and text
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What follows `SPDX-License-Identifier` for a label; words in braces must stand as they are.
SPDX = {
    "agpl": "{agpl}", "apache-2.0": "{apache} 2 0", "bsd": "{bsd}", "cc-by": "{cc} {by}", "cc-by-nc": "{cc} {by} {nc}", "cc-by-nc-nd": "{cc} {by} {nc} {nd}",
    "cc-by-nc-sa": "{cc} {by} {nc} {sa}", "cc-by-nd": "{cc} {by} {nd}", "cc-by-sa": "{cc} {by} {sa}", "cc0": "{cc0}", "epl": "{epl}", "gpl": "{gpl}",
    "isc": "{isc}", "lgpl": "{lgpl}", "mit": "{mit}", "mpl": "{mpl}", "unlicense": "{unlicense}", "zlib": "{zlib}",
}
#: Notices by label, as words; several for one label are alternatives, words in braces must stand as they are.
NOTICES = [
    ("afl", "academic free license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0"),
    ("artistic", "the {artistic} license"),
    ("boost", "boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the {bsd} license"),
    ("bsd", "released under the {bsd} license"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
    ("cc-by-nc", "{cc} {by} {nc}"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc-nd", "creative commons attribution non commercial no derivatives"),
    ("cc-by-nc-nd", "{cc} {by} {nc} {nd}"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-sa", "creative commons attribution non commercial share alike"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike"),
    ("cc-by-nc-sa", "{cc} {by} {nc} {sa}"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nd", "creative commons attribution no derivatives"),
    ("cc-by-nd", "{cc} {by} {nd}"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "creative commons attribution share alike"),
    ("cc-by-sa", "{cc} {by} {sa}"),
    ("cc0", "{no} rights reserved"),
    ("cc0", "creative commons {zero}"),
    ("epl", "eclipse public license"),
    ("gfdl", "gnu free documentation license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "licensed under the {mit} license"),
    ("mit", "released under the {mit} license"),
    ("mpl", "mozilla public license"),
    ("odbl", "open database license"),
    ("ofl", "sil open font license"),
    ("public-domain", "dedicated to the public domain"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    *((label, f"spdx license identifier {name}") for label, name in SPDX.items()),
]
#: Characters of a notice for each edit that it may bear, and what an edit costs where notices overlap.
SHARE, PENALTY = 9, 6
#: Characters beyond a candidate in which the end of its last word is looked for.
WORD = 32


class Notice:
    def __init__(self, label: str, marked: str, edits: int):
        import regex

        self.label, self.text = label, marked.replace("{", "").replace("}", "")
        self.own = [f" {w} " for w in re.findall(r"\{(.*?)\}", marked)]
        self.edits = min(edits, len(self.text) // SHARE)
        self.pattern = regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(self.text)}){{e<={self.edits}}}(?![^ ])")

    def found(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """Start, end and edits of its places within text[low:high]."""
        out, at = [], low
        while m := self.pattern.search(text, at, high):
            start, end = m.span()
            own = f" {text[start:end]} "
            if all(w in own for w in self.own) and text[end : end + 1] in ("", " "):
                out.append((start, end, sum(m.fuzzy_counts)))
                at = max(end, start + 1)
            else:
                at = start + 1
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], edits: int):
        import ahocorasick

        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices = [Notice(label, marked, edits) for label, marked in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            cuts = [len(notice.text) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice.text[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        if seeds:
            self.seeds.make_automaton()

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """The first word and the label of each place of a phrase; joined: the words, with a space before, between and after."""
        out = []
        for phrase, label in self.phrases:
            at, word, counted = joined.find(phrase.encode()), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                out.append((word, label))
                at = joined.find(phrase.encode(), at + 1)
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """Label, start, end and edits of the notices' places; of those that overlap the best."""
        seeds: dict[int, set[int]] = {}
        for end, (size, uses) in self.seeds.iter(text) if len(self.seeds) else ():
            for k, offset in uses:
                seeds.setdefault(k, set()).add(end + 1 - size - offset)
        found: dict[tuple[str, int, int], int] = {}
        for k, starts in seeds.items():
            n, done = self.notices[k], -math.inf
            for start in sorted(starts):
                if start + n.edits < done:  # within a place that was found
                    continue
                high = start + len(n.text) + n.edits
                high = min(len(text), high + WORD if (space := text.find(" ", high, high + WORD)) < 0 else space)
                for a, b, edits in n.found(text, max(0, start - n.edits), high):
                    found[n.label, a, b] = min(edits, found.get((n.label, a, b), edits))
                    done = b
        taken: list[tuple[str, int, int, int]] = []
        for label, start, end, edits in sorted(((*f, e) for f, e in found.items()), key=lambda f: (f[1] - f[2] + PENALTY * f[3], f[1], f[0])):
            k = bisect.bisect([t[1] for t in taken], start)
            if (not k or taken[k - 1][2] <= start) and (k == len(taken) or taken[k][1] >= end):
                taken.insert(k, (label, start, end, edits))
        return taken


def license_scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, edits: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: its id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (label, start and end in the normalised text, edits) of the notices."""

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(phrases, notices, edits)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                joined = b" ".join([b"", *words, b""])
                base = scanner.exact(joined)
                near = scanner.fuzzy(joined[1:-1].decode(errors="replace")) if words else []
                exact = {label for _, label in base}
                labels = exact | {label for label, *_ in near}
                best = 1.0 if base else max((1 - n / max(1, b - a) for _, a, b, n in near), default=0.0)
                places = [w for w, _ in base]
                values = (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(exact)), ",".join(sorted(labels)), best,
                          [{"label": x, "start": a, "end": b, "edits": n} for x, a, b, n in near])
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, start: long, end: long, edits: long>>",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
