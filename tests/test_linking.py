"""Joins that many rows could make quadratic, against plain loops: parties, amounts, mentions, pictures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import cluster, joins, recon


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "business_no string, up_contract_no string, supplier string, customer string, up_contract_amount decimal(18,2), up_settlement decimal(18,2), pay_amount decimal(18,2), down_settlement decimal(18,2), receipt_amount decimal(18,2), interest_received decimal(18,2)")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "document_id string, contract_no string, direction string, role string, amount decimal(18,2), seller string, company string")


def test_a_party_of_many_lines_makes_no_pairs(spark):
    """Two thousand documents and lines of one firm and one amount: nothing binds, and no row stands for a pair."""
    from decimal import Decimal

    n, amount = 2000, Decimal("500.00")
    lines = lines_of(spark, [(f"L{k}", "", "Great Works", "Client", amount, None, None, None, None, None) for k in range(n)] + [("solo", "", "Small Shop", "Client", Decimal(7), None, None, None, None, None)])
    docs = docs_of(spark, [(f"d{k}", "", "unknown", "invoice", amount if k % 2 else None, "Great Works Ltd", None) for k in range(n)] + [("one", "", "unknown", "invoice", None, "Small Shop", None), ("two", "", "unknown", "invoice", Decimal(7), "Great Works", None), ("three", "", "unknown", "invoice", None, None, "Small Shop East")])
    for found in (recon.party_reach(docs, lines), recon.amount_reach(docs.filter("amount IS NOT NULL"), lines)):
        assert found.count() <= n + 3
    bound, pool = recon.bind(lines, docs, ["up_contract_no"], ["up_contract_no"])
    assert sorted((r.document_id, r.business_no, r.direction, r.basis) for r in bound.collect()) == [("one", "solo", "up", "party"), ("three", "solo", "up", "party")]
    assert pool.count() == n + 1


def test_short_and_long_texts_hold_words(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 3, 9, 63, 64, 65, 200]))) for _ in range(120)] + [None, "ab" * 40]
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 4, 5, 9]))) for _ in range(40)] + ["", "ab" * 40, "ab" * 33, None]
    t, w = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in words], "w string")
    got = sorted(map(tuple, joins.containment_join(t, w, "t", "w").collect()))
    assert got == sorted({(x, y) for x in texts for y in words if x is not None and y and y in x})
    assert joins.containment_join(t, w.limit(0), "t", "w").count() == 0


def plain_mentions(text, number):
    compact = re.sub(r"\s+", "", text or "")
    if number in compact:
        return True
    parts = number.split("-")
    return len(parts) >= 3 and parts[-1] != "" and re.search(rf"-{re.escape(parts[-2])}-[0-9/]{{0,40}}{re.escape(parts[-1])}(?![0-9])", compact) is not None


def test_mentions(spark):
    rng = random.Random(5)
    numbers = ["HS-2026-0200", "HS-2026-0236", "HS-2025-0200", "XS-1-26-7", "HS-2026-YC0453", "HS-2026-12A", "AB-2026", "A-2026-", "HS(DD)-2026-36", "S-2026-1+", ""]
    pieces = ["HS (DD)\n-2026-0200/0236/0251", "-2026-", "0236", "/", "-2025-02000", "0200", "YC0453", " 2026-", "HS-2026-0200", "-26-17/7", "12A", "x", "\n", "-", "36/", "1+", "-2026-" + "1/" * 19 + "36", "-2026-" + "1/" * 21 + "36", "-2026-A-2026-36"]
    texts = [None, "", *("".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(150))]
    got = joins.mentions(spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in numbers], "n string"), "t", "n")
    assert sorted(map(tuple, got.collect())) == sorted({(x, n) for x in texts for n in numbers if n and x is not None and plain_mentions(x, n)})


def test_statements(spark):
    lines = spark.createDataFrame([("L1", "HS（DD）-2026-0200", ""), ("L2", "HS(DD)-2026-0236", None), ("L3", "HS-2026-0999", "")], "business_no string, up string, down string")
    docs = spark.createDataFrame([("s", "other", "对账 HS(DD)\n-2026-0200/0236"), ("t", "invoice", "HS(DD)-2026-0200"), ("u", "other", None)], "document_id string, role string, text string")
    assert sorted((r.document_id, r.business_no, r.basis) for r in recon.statements(lines, docs, ["up", "down"]).collect()) == [("s", "L1", "statement"), ("s", "L2", "statement")]


def test_equal_pictures_are_rows_and_not_pairs(spark):
    rows = spark.createDataFrame([(k, "00ff00ff00ff00ff", 9, 8, None) for k in range(400)], "id long, phash string, img_w int, img_h int, amount decimal(18,2)")
    members, pairs = cluster.same_image(rows, "id")
    assert members.filter("id <> class_id").count() == 399 and pairs.count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pictures_of_a_cell_against_the_loop(spark, seed):
    from decimal import Decimal

    rng = random.Random(seed)
    rows = []
    for k in range(120):
        bits = sum(1 << b for b in rng.sample(range(7), rng.randint(0, 4)))
        rows.append((k, rng.choice("ab"), "up", "invoice", f"{bits:016x}" if rng.random() < 0.9 else None, 9, rng.choice([8, 8, 9]), rng.choice([None, Decimal("1.00"), Decimal("2.00")])))
    docs = spark.createDataFrame(rows, "document_id long, business_no string, direction string, role string, phash string, img_w int, img_h int, amount decimal(18,2)")
    got = {r.id: r.kept_id for r in cluster.image_leaders(docs, "document_id", recon.CELL).collect()}
    kept, want = [], {}
    for r in rows:
        if r[4] is None:
            continue
        same = [o for o in kept if o[1:4] == r[1:4] and o[5:7] == r[5:7] and bin(int(o[4], 16) ^ int(r[4], 16)).count("1") <= 1 and (o[7] is None or r[7] is None or abs(o[7] - r[7]) < Decimal("0.01"))]
        want[r[0]] = same[0][0] if same else r[0]
        if not same:
            kept.append(r)
    assert got == want


def test_few_and_many_words_are_found_alike(spark):
    """Words that are looked for one by one and by the filter give what a loop does; equal keys aren't merged."""
    r = random.Random(1)
    word = lambda a, b: "".join(r.choice("ab中é-😀") for _ in range(r.randint(a, b)))
    words = [word(1, 10) for _ in range(60)] + ["ab" * 20, "a" * 70, ""]
    texts = [word(0, 80) for _ in range(60)] + [word(200, 900) for _ in range(10)] + ["x" * 250 + "ab" * 20 + "y", "z" * 255 + words[5], None, "", "q" * 100 + "a" * 71]
    want = sorted({(x, y) for x in texts for y in words if x is not None and y and y in x})
    t, w = spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(x,) for x in words], "w string")
    for few in (0, 200):
        assert sorted(map(tuple, joins.containment_join(t, w, "t", "w", few=few).collect())) == want
        keyed = joins.containment_join(t, w, "t", "w", few=few, key="k").collect()
        assert sorted((texts[k], y) for k, y in keyed) == sorted((x, y) for x in texts for y in set(words) if x is not None and y and y in x)


def test_subset_sums_make_no_row_for_each_mask(spark):
    lines = spark.createDataFrame([("1", "10.00")], "business_no string, pay_amount string").withColumn("pay_amount", F.col("pay_amount").cast("decimal(18,2)"))
    docs = spark.createDataFrame([(x, "1", "unknown", "invoice", a) for x, a in (("a", 4), ("b", 6), ("c", 3), ("d", 7), ("e", 0))], "document_id string, business_no string, direction string, role string, amount int")
    sums = recon.subset_sums(docs.withColumn("amount", F.col("amount").cast("decimal(18,2)")), lines)
    assert sorted(r.document_id for r in sums.collect()) == ["a", "b", "e"]
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") <= 2
