"""A corpus pipeline of five stages over `documents`, each of one operator of quillon.llm.

Each stage takes (spark, docs, sf_dir) and is judged on what its predecessor kept; run() writes each stage's rows as
Parquet into the shared folder and reads them again.  All stages but the last return the columns of documents.  A
stage keeps rows whose id is null, repeated rows stay or go together, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, line_dedup, near_copies, simhash, toxicity
from quillon.llm.common import written


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in bad; rows whose id is null stay."""
    name = "bad-" + "-".join(docs.columns)  # no column of docs has this name
    return docs.join(bad.select("doc_id").distinct().toDF(name), F.col("doc_id") == F.col(f"`{name}`"), "left_anti")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.toxicity(docs, labels, held_out=toxicity.held_out(F.col("doc_id")))
    return without(docs, found.filter("predicted = 1"))


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line of at least ten code points only in the first document that holds it; n_chars follows the text."""
    return line_dedup.line_dedup(docs, counts=False).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.  Documents are linked if their fingerprints of
    three words differ in two bits or fewer, or if 0.8 or more of their shingles of five words are the same."""
    found = simhash.near_duplicates(docs).filter("doc_id <> component_id")
    links = found.select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst")).union(near_copies.near_links(docs))
    groups = simhash.components(links.distinct()).filter("node <> component")
    return without(docs, groups.select(F.col("node").alias("doc_id")))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of whose words a twentieth or more stand in passages of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return bpe.bpe(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: No SQL dialect expresses the model, XXH64 or BPE; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
