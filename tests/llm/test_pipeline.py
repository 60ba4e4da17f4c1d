"""The corpus pipeline against brute force, stage by stage."""

import shutil
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quillon.llm.common import written  # noqa: E402


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    steps, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        steps.append(docs)
    assert all(s.columns == documents.columns for s in steps[:-1])
    clean, lines, near, fresh, encoded = steps[1:]
    assert set(pairs(clean)) <= set(pairs(documents)) and clean.count() > 0.7 * documents.count()
    brute.same(lines.collect(), [(d, t) for d, _, _, t in brute.line_dedup(pairs(clean))], ["doc_id", "text"])
    kept = {d for d, _, c in brute.components(pairs(lines)) if d == c}
    brute.same(near.collect(), [(d, t) for d, t in pairs(lines) if d in kept], ["doc_id", "text"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.decontaminate(pairs(near), items) if r[-1]}
    brute.same(fresh.collect(), [(d, t) for d, t in pairs(near) if d not in bad], ["doc_id", "text"])
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    brute.same(encoded.collect(), [(d, len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t in pairs(fresh)], ["doc_id", "n_tokens"])


def test_empty(spark, sf, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op8_url_filter", "op10_exact_dedup"])
def test_sql(spark, sf, name):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import parity

    from quillon.llm import registry

    parity.check(spark, parity.connection(sf), sf, registry.queries()[name], registry.oracle_sql()[name])
