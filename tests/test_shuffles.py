"""What reconciliation moves between tasks, by plans on small tables, and the same results."""

from decimal import Decimal

from pyspark.sql import functions as F

from quillon.operators import joins, recon


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(spark):
    rows = [("1", "CG-1", Decimal("10.00")), ("2", "CG-2", Decimal("20.00")), ("2", "CG-3", Decimal("30.00"))]
    return spark.createDataFrame(rows, "business_no string, up_contract_no string, pay_amount decimal(18,2)")


def docs_of(spark):
    rows = [
        ("a", "1", "up", "invoice", "payment", Decimal("10.00"), None, ""), ("b", "1", "up", "invoice", "payment", None, "2020-01-01", "CG-1"),
        ("c", "1", "up", "invoice", "payment", Decimal("10.01"), "2020-01-01", "XX"), ("d", "1", "up", "invoice", "payment", Decimal("10.01"), "2020-01-01", "XX"),
        ("e", "2", "down", "settlement", "payment", Decimal("5.00"), None, "CG-2"), ("f", "2", "unknown", "invoice", "payment", Decimal("20.00"), None, None),
        ("g", "2", None, "contract", "deposit", Decimal("1.00"), "2020-01-01", "CG-2"),
    ]
    rows = spark.createDataFrame(rows, "document_id string, business_no string, direction string, role string, nature string, amount decimal(18,2), doc_date string, contract_no string")
    return rows.withColumn("doc_date", F.to_date("doc_date"))


def test_documents_without_a_key_are_not_moved(spark):
    lone = docs_of(spark).withColumn("contract_no", F.lit(""))
    out = recon.unique_in_cell(lone)
    assert "Exchange" not in plan(out)
    assert all(r.document_id == r.kept_id for r in out.collect())


def test_documents_go_to_their_lines_once(spark):
    lines, docs = lines_of(spark).filter("up_contract_no <> 'CG-3'"), docs_of(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wide = recon.wide(lines, docs)
        assert plan(wide).count("Exchange") <= 2  # documents and lines
        rows = {r.business_no: r for r in wide.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one, two = rows["1"], rows["2"]
    assert (one.cell_up_invoice.n, one.cell_up_invoice.ids, one.cell_up_invoice.amount) == (4, ["a", "b", "c", "d"], Decimal("20.01"))
    assert (one.n_bound, one.waiting_invoice or 0, two.n_bound, two.waiting_invoice) == (4, 0, 3, 1)
    assert two.cell_down_settlement.ids == ["e"] and two.cell_up_invoice is None
    assert sorted(r.n for r in recon.cells(docs).collect()) == [1, 4]


def test_alien_numbers_meet_their_line_once(spark):
    lines, docs = lines_of(spark), docs_of(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = recon.r5_membership(lines, docs, ["up_contract_no"])
        assert plan(out).count("Exchange") <= 2
        got = sorted((r.business_no, r.severity, *r.document_ids) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # line 2 stands twice, so its document breaks the chain with one of them
    assert got == [("1", "INFO", "c"), ("1", "INFO", "d"), ("2", "WARNING", "e")]


def test_binding_keeps_what_is_asked(spark):
    lines = lines_of(spark).filter("up_contract_no <> 'CG-3'").select("business_no", "up_contract_no", F.lit("").alias("down_contract_no"), "pay_amount")
    docs = docs_of(spark).drop("business_no").withColumn("direction", F.lit("unknown")).withColumn("filename", F.lit("x.pdf"))
    bound, pool = recon.bind(lines, docs, ["up_contract_no"], ["down_contract_no"], ["role", "amount"])
    assert set(bound.columns) == {"document_id", "direction", "role", "amount", "business_no", "basis", "multi"}
    whole, rest = recon.bind(lines, docs, ["up_contract_no"], ["down_contract_no"])
    assert "filename" in whole.columns
    key = lambda df: sorted((r.document_id, r.business_no, r.direction, r.basis) for r in df.collect())
    assert key(bound) == key(whole) and pool.count() == rest.count()


def test_bins_of_amounts_are_longs(spark):
    a = spark.createDataFrame([(1, Decimal("9999999999999999.99")), (2, Decimal("-0.01")), (3, None)], "k int, x decimal(18,2)")
    b = spark.createDataFrame([(1, Decimal("9999999999999999.98")), (2, Decimal("0.00")), (3, None)], "j int, y decimal(18,2)")
    out = joins.tolerance_join(a, b, "x", "y")
    assert "decimal(30,0)" not in plan(out)
    assert sorted((r.k, r.j) for r in out.collect()) == [(1, 1), (2, 2)]
    assert sorted((r.k, r.j) for r in joins.tolerance_join(a, b, "x", "y", "0.0001").collect()) == []


def test_pictures_without_neighbours_take_no_rounds(spark, monkeypatch):
    """Copies alone: members and links are all that is written, and rows of a group go to it once."""
    from quillon.operators import cluster
    from quillon.sources import shared

    made, write = [], shared.written_to
    monkeypatch.setattr(shared, "written_to", lambda df, path, **o: (made.append(path), write(df, path, **o))[1])
    docs = docs_of(spark).withColumns({"phash": F.lit("0" * 16), "img_w": F.lit(9), "img_h": F.lit(8), "amount": F.lit(None).cast("decimal(18,2)")})
    got = {r.id: r.kept_id for r in cluster.image_leaders(docs.filter("direction IS NOT NULL"), "document_id", recon.CELL).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}
    assert len(made) <= 3
    out = recon.unique_in_cell(docs.filter("direction IS NOT NULL"))
    assert sorted((r.document_id, r.kept_id) for r in out.collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "f")]


def test_only_pairs_are_counted_without_a_window(spark):
    pairs = spark.createDataFrame([(1, "x", 1), (2, "y", None), (2, "y", None), (3, None, None), (None, "z", 4)], "a int, b string, c int")
    out = joins.unique_hits(pairs, "a")
    assert "Window" not in plan(out)
    assert {tuple(r) for r in out.collect()} == {(1, "x", 1), (3, None, None), (None, "z", 4)}
