"""Hashes, fingerprints and distances as columns (AGG-31 to AGG-33, FN-70 to FN-73)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def as_bits(hexa: Column) -> Column:
    """Sixteen hex digits as a signed long; null for anything else."""
    return F.when(hexa.rlike("^[0-9a-fA-F]{16}$"), F.conv(hexa, 16, -10).cast("long"))


def hamming(a: Column, b: Column, invalid: int = 64) -> Column:
    """FN-71, FN-72: differing bits of two hex fingerprints."""
    return F.coalesce(F.bit_count(as_bits(a).bitwiseXOR(as_bits(b))), F.lit(invalid))


def simhash(tokens: DataFrame, keys: list[str], token: str) -> DataFrame:
    """AGG-32: a fingerprint for each group of `keys`: the majority of each bit of the first 64 bits of the tokens' MD5; a
    tie is 0.  One row for each token and 64 conditional sums, so the shuffle carries 64 counters a group."""
    bits = F.conv(F.substring(F.md5(F.col(token).cast("binary")), 1, 16), 16, -10).cast("long")
    votes = tokens.select(*keys, bits.alias("_bits")).groupBy(*keys).agg(
        *[F.sum(F.shiftrightunsigned("_bits", k).bitwiseAND(1) * 2 - 1).alias(f"_v{k}") for k in range(64)]
    )
    value = F.lit(0).cast("long")
    for k in range(64):
        value = value.bitwiseOR(F.when(F.col(f"_v{k}") > 0, F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, F.lpad(F.lower(F.hex(value)), 16, "0").alias("simhash"))


def structure_words(text: Column, words: list[str] = config.STRUCTURE_WORDS) -> Column:
    """FN-73: the structure words in a text, digits and punctuation aside."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\d\s\-_:：/\\,.，。]", "")
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(bare, w))


def count_in(text: Column, word: Column) -> Column:
    """AGG-31: places of a word that don't overlap."""
    return F.when(F.char_length(word) > 0, ((F.char_length(text) - F.char_length(F.replace(text, word, F.lit("")))) / F.char_length(word)).cast("int"))


def layout_hash(items: DataFrame, key: str, x: str, y: str, width: str, height: str, size: int = 10) -> DataFrame:
    """AGG-33: SHA-256 of the numbers of boxes (9 at most) in each cell of a grid, row by row."""
    cell = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(size - 1), F.floor(F.col(a) / F.col(b) * size).cast("int"))).otherwise(0)
    at = cell(y, height) * size + cell(x, width)
    counts = items.groupBy(key, at.alias("_cell")).agg(F.least(F.lit(9), F.count("*").cast("int")).alias("_n"))
    filled = F.map_from_entries(F.collect_list(F.struct("_cell", "_n")))
    grid = counts.groupBy(key).agg(filled.alias("_grid"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.col("_grid")[k], F.lit(0)).cast("string"))
    return grid.select(key, F.sha2(F.array_join(cells, ","), 256).alias("layout_hash"))
