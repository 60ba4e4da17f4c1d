"""Each stage of the pipeline on odd rows: null ids, repeated rows, empty and very long texts, columns of any name, empty tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _bad int, n_lines int, n_dropped string, kept int, page string, `a.b` int, label int, bits int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["house", "river", "field", "book", "light", "town", "road", "stone", "garden", "winter", "letter", "window"]
    path = f"file://{tmp_path_factory.mktemp('stages')}"
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, sentence(60) + (" vermin" * 3 if i % 4 == 0 else "") + f" end{i}") for i in range(200)]
    passage = " ".join(f"bench{k}" for k in range(40))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, sentence(100_000)), (904, passage), (905, "x" * 200_000), (None, sentence(30)), (None, None), (None, sentence(30))]
    rows += [rows[1], rows[1], rows[3], (906, rows[5][1]), (907, rows[5][1] + " more"), (908, "the same long line\nown line one"), (909, "own line two\nTHE SAME LONG LINE ")]
    extra = ("en", "s", 1, 7, 8, "d", 9, "p", 10, 11, 12)
    spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, folder, k):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.STAGES[k][1](spark, docs, path)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {(r["_bad"], r["n_dropped"], r["kept"], r["page"], r["a.b"], r["bits"]) for r in kept} == {(7, "d", 9, "p", 10, 12)}
    ids = [r.doc_id for r in kept]
    assert ids.count(None) == 3 and {900, 901, 903, 905} - set(ids) <= {901, 902}
    if k == 0:
        assert {i for i in ids if i is not None and i < 200} == {i for i in range(200) if i % 4} and ids.count(1) == 3
    if k == 1:
        assert len(kept) == len(rows) and {r.doc_id: r.text for r in kept}[909] == "own line two"
    if k == 2:
        assert ids.count(1) == 3 and 906 not in ids and 907 not in ids and 5 in ids
    if k == 3:
        assert 904 not in ids and len(kept) == len(rows) - 1


def test_no_rows(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert [stage(spark, docs, path).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
