"""Operators on small tables: reconciliation scenarios, joins, lifecycle, files, streams."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.operators import cluster, dossier, eav, joins, ledger, lifecycle, recon, reports, rules
from quillon.sources import files, seeds
from quillon.streaming import jobs

LINE = "business_no string, up_contract_no string, down_contract_no string, up_contract_amount decimal(18,2), up_settlement decimal(18,2), down_settlement decimal(18,2), pay_amount decimal(18,2), receipt_amount decimal(18,2), interest_receivable decimal(18,2), interest_received decimal(18,2), up_contract_date date, down_contract_date date, supplier string, customer string, vessel string"
DOC = "document_id string, contract_no string, direction string, role string, nature string, amount decimal(18,2), doc_date date, invoice_no string, seller string, company string, text string"
D = Decimal


def line(spark, **values):
    base = dict(business_no="Y1", up_contract_no="CG-1", down_contract_no="XS-1", up_contract_amount=None, up_settlement=None, down_settlement=None, pay_amount=None, receipt_amount=None, interest_receivable=None, interest_received=None, up_contract_date=None, down_contract_date=None, supplier="上游供应商", customer="下游客户", vessel="MV TEST")
    return spark.createDataFrame([tuple((base | values).values())], LINE)


def docs(spark, *rows):
    base = dict(document_id="1", contract_no="CG-1", direction="up", role="invoice", nature="payment", amount=None, doc_date=None, invoice_no=None, seller=None, company=None, text=None)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], DOC)


def found(spark, lines, documents):
    bound, _ = recon.bind(lines, documents, ["up_contract_no"], ["down_contract_no"])
    return bound, recon.differences(lines, bound, ["up_contract_no", "down_contract_no"])


def severities(diffs, kind, role):
    return [r.severity for r in diffs.filter((F.col("type") == kind) & (F.col("role") == role)).collect()]


def full(up, down=None):
    sides = [("up", up, ["settlement", "invoice", "payment_receipt"]), ("down", down or up, ["settlement", "invoice"])]
    return [dict(document_id=f"{d}{r}", contract_no="CG-1" if d == "up" else "XS-1", direction=d, role=r, amount=D(a), invoice_no=f"{d}{r}") for d, a, rs in sides for r in rs]


def test_aligned(spark):
    lines = line(spark, up_settlement=D(1000000), down_settlement=D(1010000), pay_amount=D(1000000), interest_received=D(10000))
    bound, diffs = found(spark, lines, docs(spark, *full(1000000, 1010000)))
    assert diffs.count() == 0 and recon.matrix(lines, bound).count() == 10
    assert recon.statuses(lines, bound, diffs).first().status == "ok"


def test_split_invoices(spark):
    lines = line(spark, up_settlement=D(1000000), pay_amount=D(1000000))
    rows = [r for r in full(1000000) if r["role"] != "invoice"] + [dict(document_id="a", amount=D(600000), doc_date=date(2026, 1, 1)), dict(document_id="b", amount=D(400000), doc_date=date(2026, 1, 2))]
    _, diffs = found(spark, lines, docs(spark, *rows))
    assert not severities(diffs.filter("direction = 'up'"), "amount_mismatch", "invoice")


@pytest.mark.parametrize(("invoice", "expected"), [(900000, ["WARNING"]), (1100000, ["CRITICAL"]), (1000000, [])])
def test_invoice_amounts(spark, invoice, expected):
    lines = line(spark, up_settlement=D(1000000))
    _, diffs = found(spark, lines, docs(spark, dict(document_id="s", role="settlement", amount=D(1000000)), dict(document_id="i", amount=D(invoice))))
    assert severities(diffs, "amount_mismatch", "invoice") == expected


def test_settlement_above(spark):
    _, diffs = found(spark, line(spark, up_settlement=D(1000000)), docs(spark, dict(role="settlement", amount=D(1200000))))
    assert severities(diffs, "amount_mismatch", "settlement") == ["CRITICAL"]


@pytest.mark.parametrize(("down", "receivable", "received", "expected"), [(1018000, 18000, 18000, []), (2015000 - 1000000, 20000, 15000, ["INFO"]), (1016000, 20000, 20000, ["CRITICAL"]), (1016000, None, None, ["WARNING"])])
def test_interest(spark, down, receivable, received, expected):
    lines = line(spark, up_settlement=D(1000000), down_settlement=D(down), interest_receivable=receivable and D(receivable), interest_received=received and D(received))
    assert [r.severity for r in recon.r4_interest(lines).collect()] == expected


def test_duplicates_count_once(spark):
    lines = line(spark, up_settlement=D(1000))
    twin = dict(role="settlement", amount=D(1000), doc_date=date(2026, 1, 1))
    bound, diffs = found(spark, lines, docs(spark, dict(document_id="a", **twin), dict(document_id="b", **twin)))
    cell = recon.matrix(lines, bound).filter("direction = 'up' AND role = 'settlement'").first()
    assert (cell.n, cell.amount) == (2, D("1000.00"))
    assert [r.document_ids for r in diffs.filter("rule = 'DUP'").collect()] == [["a", "b"]]


def test_binding(spark):
    lines = line(spark, up_settlement=D(500), down_settlement=D(700))
    rows = [
        dict(document_id="number", contract_no="cg（DD）-1", direction="unknown"),
        dict(document_id="amount", contract_no=None, direction="unknown", amount=D("700.01")),
        dict(document_id="party", contract_no=None, direction="unknown", seller="上游供应商有限公司"),
        dict(document_id="cargo", contract_no=None, direction="unknown", role="cargo_right", text="货权转移给华山云创供应链有限公司。船名 MV　TEST"),
        dict(document_id="pool", contract_no="ZZ-9", direction="unknown", amount=D(3)),
    ]
    bound, pool = recon.bind(lines, docs(spark, *rows), ["up_contract_no"], ["down_contract_no"])
    assert {r.document_id: (r.direction, r.basis) for r in bound.collect()} == {"number": ("up", "number"), "amount": ("down", "amount"), "party": ("up", "party"), "cargo": ("up", "cargo")}
    assert [r.document_id for r in pool.collect()] == ["pool"]


def test_subset_sum(spark):
    lines = line(spark, pay_amount=D(100))
    open_ = docs(spark, *[dict(document_id=k, direction="unknown", role="payment_receipt", amount=D(a)) for k, a in (("a", 60), ("b", 40), ("c", 30), ("d", 10), ("e", 7))]).withColumn("business_no", F.lit("Y1"))
    assert sorted(r.document_id for r in recon.subset_sums(open_, lines).collect()) == ["a", "c", "d"]


def test_closure_and_resolution(spark):
    old = spark.createDataFrame([("Y1", "a", "INFO", "ignore"), ("Y1", "b", "CRITICAL", None)], "business_no string, key string, severity string, resolution string")
    new = spark.createDataFrame([("Y1", "a", "WARNING"), ("Y1", "c", "INFO")], "business_no string, key string, severity string")
    assert {r.key: (r.state, r.closed, r.severity) for r in recon.closure(old, new).collect()} == {"a": ("carried", True, "WARNING"), "b": ("resolved", False, "CRITICAL"), "c": ("new", False, "INFO")}
    assert recon.resolve(old, "Y1", "b", "pending").filter("key = 'b'").first().resolution == "pending"
    with pytest.raises(ValueError):
        recon.resolve(old, "Y1", "b", "nonsense")


def test_tolerance_join_matches_loop(spark):
    import random

    random.seed(5)
    a = [(i, D(random.randint(-300, 300)) / 100) for i in range(60)] + [(99, None)]
    b = [(i, D(random.randint(-300, 300)) / 100) for i in range(60)] + [(98, None)]
    left, right = spark.createDataFrame(a, "i int, x decimal(18,2)"), spark.createDataFrame(b, "j int, y decimal(18,2)")
    got = sorted((r.i, r.j) for r in joins.tolerance_join(left, right, "x", "y", "0.03").collect())
    assert got == sorted((i, j) for i, x in a for j, y in b if x is not None and y is not None and abs(x - y) <= D("0.03"))


def test_containment_join_matches_loop(spark):
    a, b = ["abcdefg", "xx", "", "海兴168 abcd"], ["abcd", "cdefg", "x", "", "海兴168", "zz", "abcde"]
    got = sorted((r.t, r.w) for r in joins.containment_join(spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "w string"), "t", "w").collect())
    assert got == sorted((t, w) for t in a for w in b if w and w in t)


def test_statement_mentions(spark):
    rows = spark.createDataFrame([("对账 HSYCXS (DD)\n-2026-0200/0236/0251 金额",)], "t string")
    hits = rows.select(joins.statement_mentions(F.col("t"), F.array(*map(F.lit, ["HSYCXS(DD)-2026-0236", "HSYCXS-2026-0251", "HSYCXS-2026-025", "XS-9"])))).first()[0]
    assert hits == ["HSYCXS(DD)-2026-0236", "HSYCXS-2026-0251"]


def test_rules(spark):
    table = [dict(category=c, keyword=k, match_type=m, priority=p, weight=w) for c, k, m, p, w in [("销售合同", "销售合同", "contains", 50, 2.0), ("销售合同", "合同编号", "contains", 10, 1.0), ("发票", "发票号码", "regex", 10, 1.0), ("发票", "NOTES", "exact", 5, 0.5), ("发票", "[", "regex", 5, 1.0)]]
    rows = spark.createDataFrame([(1, "销售合同\n合同编号：1"), (2, "x\nNOTES\n发票号码"), (3, None), (4, "NOTES x")], "id int, t string")
    got = {(r.id, r.category): (float(r.score), r.matched_keywords, r.priority_hits) for r in rules.rule_scores(rows, table, "id", "t").collect()}
    assert got == {(1, "销售合同"): (3.0, ["销售合同", "合同编号"], 1), (2, "发票"): (1.5, ["发票号码", "NOTES"], 0)}
    names = spark.createDataFrame([(1, "hsycxs-1.pdf"), (2, "x")], "id int, n string")
    assert [r.category for r in rules.filename_rule(names, seeds.filename_rules(), "id", "n").orderBy("id").collect()] == ["合同/销售合同", None]


def test_leader_and_pairs(spark):
    rows = spark.createDataFrame([(1, "L1", "1" * 16), (2, "L1", "f" * 16), (3, "L2", "1" * 15 + "3"), (4, "L3", None)], "id long, l string, p string")
    assert {r.id: r.leader for r in cluster.leader_clusters(rows, "id", "l", "p").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [(r.a, r.b, r.distance) for r in cluster.near_pairs(rows, "id", "p").collect()] == [(1, 3, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_leaders_in_order_of_ids(spark, seed):
    """Against the loop over documents in the order of their ids."""
    import random

    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(120):
        bits = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            bits ^= 1 << rng.randint(0, 11)
        rows.append((i, rng.choice([None, "", "A", "B"] + [f"L{i}"] * 8), rng.choice([f"{bits:016x}"] * 9 + [None])))
    leaders, want = [], {}
    for i, layout, print_ in rows:
        near = [j for j, x, y in leaders if (layout and x == layout) or (print_ and y and (int(print_, 16) ^ int(y, 16)).bit_count() <= 5)]
        want[i] = min(near, default=i)
        if not near:
            leaders.append((i, layout, print_))
    table = spark.createDataFrame(rows, "id long, l string, p string").repartition(3)
    assert {r.id: r.leader for r in cluster.leader_clusters(table, "id", "l", "p").collect()} == want


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_near_pairs_miss_nothing(spark, monkeypatch, blocks):
    import random

    monkeypatch.setattr(cluster, "MEET", 0)
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = [rng.choice(base) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for _ in range(80)]
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    want = {(min(first[a], first[b]), max(first[a], first[b])) for a in first for b in first if a != b and (a ^ b).bit_count() <= 5}
    rows = spark.createDataFrame([(i, f"{p:016x}") for i, p in enumerate(prints)], "id long, p string")
    got = cluster.near_pairs(rows, "id", "p", most_blocks=blocks).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_many_equal_names(spark):
    docs = spark.range(1200).withColumns({"d": F.lit("x"), "n": F.lit("a.txt")}).union(spark.createDataFrame([(5000, "y", "a.txt"), (5001, "x", "b")], "id long, d string, n string"))
    names = [(r.directory, r.filename) for r in lifecycle.unique_names(docs, F.col("d"), F.col("n")).orderBy("id").collect()]
    assert len(set(names)) == 1202 and names[0] == ("x", "a.txt") and names[7] == ("x", "a_007.txt") and names[1199] == ("x", "a_1199.txt")


def test_rules_that_do_not_work(spark):
    docs = spark.createDataFrame([(1, "aab"), (2, None)], "id long, t string")
    odd = [{"category": "c", "keyword": k, "match_type": "regex", "priority": 1, "weight": 1.0} for k in ("(?P<n>a)", "(", "a{2}")]
    assert [(r.id, r.matched_keywords) for r in rules.rule_scores(docs, odd, "id", "t").collect()] == [(1, ["a{2}"])]
    assert rules.rule_scores(docs, [], "id", "t").count() == 0 and rules.best_rule(rules.rule_scores(docs, [], "id", "t"), "id").count() == 0
    assert [r.rule_id for r in rules.filename_rule(docs, [], "id", "t").collect()] == [None, None]
    assert [r.sample_id for r in rules.sample_scores(docs, [], "id", "t").collect()] == [None, None]


def test_containment_of_long_texts(spark):
    text = " ".join(str(k) for k in range(20_000))  # over 100,000 characters
    got = joins.containment_join(spark.createDataFrame([(text,), ("19999",)], "t string"), spark.createDataFrame([("19998 19999",), ("1",), ("zz",)], "w string"), "t", "w")
    assert sorted((len(r.t), r.w) for r in got.collect()) == sorted([(len(text), "19998 19999"), (len(text), "1"), (5, "1")])


def test_company_names(spark):
    rows = spark.createDataFrame([("山西宏达钢铁有限公司",), ("签字盖章处理",), ("1234-5",), ("abc",)], "n string")
    assert [r[0] for r in rows.select(cluster.valid_company(F.col("n"))).collect()] == [True, False, False, False]


def test_assignment_by_sums(spark):
    """A receipt by its amount, two more by their sum."""
    lines = line(spark, pay_amount=D(100), receipt_amount=D(70))
    open_ = docs(spark, *[dict(document_id=k, direction="unknown", role="payment_receipt", amount=D(a)) for k, a in (("a", 60), ("b", 40), ("c", 70))]).withColumn("business_no", F.lit("Y1"))
    assert {r.document_id: r.direction for r in recon.assign(lines, open_).collect()} == {"a": "up", "b": "up", "c": "down"}


def test_reports(spark):
    status = spark.createDataFrame([("1", "ok", 1), ("2", "error", 2), ("3", "no_data", 0)], "business_no string, status string, n_docs long")
    diffs = spark.createDataFrame([("2", "R1", "missing_doc", "CRITICAL", "up", "invoice", "k2"), ("2", "R2", "amount_mismatch", "INFO", "up", "invoice", "k1")], "business_no string, rule string, type string, severity string, direction string, role string, key string")
    got = {r.business_no: r for r in reports.detail(reports.encode(status, diffs)).collect()}
    assert [d.key for d in got["2"].diffs] == ["k1", "k2"] and got["2"].n_critical == 1 and got["1"].rules == []
    assert [r.business_no for r in reports.page(status.withColumn("id", F.col("business_no")), order="id").collect()] == ["2", "1", "3"]
    assert [r.business_no for r in reports.page(status.withColumn("id", F.col("business_no")), keyword="ER", columns=("status",)).collect()] == ["2"]
    old = status.withColumn("urges", F.lit(None).cast("array<struct<at: timestamp, note: string>>"))
    once = reports.urged(old, spark.createDataFrame([("2",), ("9",)], "business_no string"), F.lit("please"), F.lit("2026-01-01"))
    twice = {r.business_no: r.urges for r in reports.urged(once, spark.createDataFrame([("2",)], "business_no string"), F.lit("again"), F.lit("2026-01-02")).collect()}
    assert [u.note for u in twice["2"]] == ["please", "again"] and twice["1"] is None


def test_ledger(spark):
    headers = ["销售合同编号OA", "船 名", "单价", "数量", "单价", "销售合同金额"]
    assert ledger.column_map(headers) == {"contract_no": 0, "vessel": 1, "unit_price": 2, "unit_price_sale": 4, "quantity": 3, "amount": 5}
    assert ledger.header_row([["报表"], headers]) == 1
    rows = spark.createDataFrame([("YWX401", "3,400,374", "2026年5月14日", "回款"), ("", "5", "", ""), ("Y", "x", "", ""), ("YWX401", "(1,500,000)", "2026-06-01", "回款")], "`业务线` string, `金额` string, `日期` string, `类型` string")
    good, bad = ledger.import_details(rows, "B1", {"business_no": "业务线", "amount": "金额", "occurred_on": "日期", "kind": "类型"})
    assert bad.count() == 2 and ledger.detail_totals(good, "business_no").first().receipt_total == D("4900374.00")
    with pytest.raises(ValueError):
        ledger.import_details(rows, "B1", {"business_no": "业务线"})


def test_lifecycle(spark):
    documents = spark.createDataFrame([(1, "archived"), (2, "need_review"), (3, "failed")], "id long, status string")
    ids = spark.createDataFrame([(2,), (9,), (1,)], "id long")
    changed, result = lifecycle.set_status(documents, ids, "archived", ["need_review"])
    assert {r.id: r.result for r in result.collect()} == {2: "ok", 9: "not_found", 1: "wrong_status"}
    assert {r.id: r.status for r in changed.collect()} == {1: "archived", 2: "archived", 3: "failed"}
    gone, recycled = lifecycle.recycle(documents, ids, "x", F.lit("2026-01-01").cast("timestamp"))
    back, rest = lifecycle.restore(gone, recycled, ids.filter("id = 2"))
    assert {r.id: r.status for r in back.collect()} == {1: "recycled", 2: "need_review", 3: "failed"} and rest.count() == 1


def test_dossier_guard(spark):
    asked = spark.createDataFrame([(1, "HSYCXS-2026-0027"), (2, "hsycxs－2026－0028"), (3, "HSYCXS-2026-0O29"), (4, "SJWLCG-2026-1111"), (5, "SDJZ-SXJG2026"), (6, "H5YCXS-2026-0027")], "id int, no string")
    known = spark.createDataFrame([(1, "HSYCXS-2026-0027"), (2, "HSYCXS-2026-0028"), (3, "HSYCXS-2026-0029")], "id int, no string")
    got = {r.id: (r.outcome, r.known_no) for r in dossier.fuzzy_guard(asked, known, "no", "id").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "linked", 2: "linked", 3: "ambiguous", 4: "new", 5: "invalid", 6: "ambiguous"} and got[6][1] == "HSYCXS-2026-0027"
    assert config.EXPECTED_ROLES and dossier.fuzzy_types("合童", spark.createDataFrame([("合同",), ("发票",)], "type string")).first().type == "合同"


@pytest.mark.parametrize("misread", [1, 2])
def test_guard_against_all_pairs(spark, misread):
    """Numbers of eighteen characters with one or two of them misread: the best of all known ones is found."""
    import difflib
    import random

    rng = random.Random(misread)
    known = [f"HSYCXS-2026-{rng.randrange(10**6):06d}" for _ in range(30)]
    asked = []
    for k, no in enumerate(rng.choices(known, k=25)):
        chars = list(no)
        for at in rng.sample(range(18), misread):
            chars[at] = rng.choice("ABCXYZ789")
        asked.append((k, "".join(chars)))
    got = {r.id: r for r in dossier.fuzzy_guard(spark.createDataFrame(asked, "id int, no string"), spark.createDataFrame([(n,) for n in known], "no string"), "no", "id").collect()}
    for k, no in asked:
        score = sorted((difflib.SequenceMatcher(None, no, n).ratio() for n in known), reverse=True)
        if got[k].outcome in ("similar", "ambiguous"):
            assert got[k].score == pytest.approx(score[0])
        else:
            assert no in known or got[k].outcome == "linked" or score[0] < 0.75


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("金额：128,500.00 元".encode("gb18030"))
    (tmp_path / "b.csv").write_text('客户名称;编号\n"A;B 公司";DD001\n;\n', encoding="utf-8")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "~$lock.docx").write_text("x")
    (tmp_path / "c.exe").write_text("x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.name for r in found.select("name").collect()) == ["a.txt", "b.csv", "d.pdf"]
    assert files.texts(found).first().text == "金额：128,500.00 元"
    assert [r.cells for r in files.delimited(found).orderBy("line").collect()] == [["客户名称", "编号"], ["A;B 公司", "DD001"]]

    def broken(content, name):
        raise RuntimeError("no")

    assert {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.parsed(found, {"pdf": broken, "text": lambda c, n: n}).collect()} == {"a.txt": ("a.txt", None), "b.csv": (None, None), "d.pdf": (None, "RuntimeError: no")}
    answers = spark.createDataFrame([('```json\n{"document_type": "发票", "confidence": 0.8}\n```',), ("none",), ('{"document_type": "x", "confidence": 3}',)], "t string")
    assert [r.a and r.a.document_type for r in answers.select(files.answer(F.col("t")).alias("a")).collect()] == ["发票", None, None]


def test_eav(spark):
    rows = spark.createDataFrame([(1, 7, "金额", "5"), (2, 7, "amount", "6"), (3, 7, "amount", ""), (4, 8, "date", "2026")], "id long, document_id long, field_name string, field_value string")
    assert {r.document_id: (r.amount, r.date) for r in eav.pivot(rows, config.FIELD_ALIASES).select("document_id", "amount", "date").collect()} == {7: ("6", None), 8: (None, "2026")}
    assert [r.document_id for r in eav.matching(rows, ["amount", "金额"], least=5.5).collect()] == [7]


def test_guard_within_one_prefix_and_year(spark):
    """Two thousand known numbers of one prefix and year, asked for with misreadings, insertions and losses, and strangers: the outcome is
    that of comparing all."""
    import difflib
    import random

    rng = random.Random(8)
    known = [f"HSYCXS-2026-{rng.randrange(10**6):06d}" for _ in range(2000)] + ["SJWLCG-2025-1", "HSYCXS-2026"]
    asked = []
    for k in range(90):
        chars = list(rng.choice(known))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = [rng.choice("ABCXYZ0123456789")] * rng.choice([0, 1, 1, 2])
        asked.append((k, "".join(chars)))
    asked += [(100, "QQQQ"), (101, ""), (102, "-"), (103, "HSYCXS-2026-" + "9" * 60), (104, None), (105, asked[0][1])]
    got = {r.id: r for r in dossier.fuzzy_guard(spark.createDataFrame(asked, "id int, no string"), spark.createDataFrame([(n,) for n in known], "no string"), "no", "id").collect()}
    assert len(got) == len(asked)
    for k, no in asked:
        if (no or "") in known:
            assert got[k].outcome == "linked"
            continue
        two = sorted((-difflib.SequenceMatcher(None, no, n).ratio(), n) for n in set(known))[:2] if no else [(0.0, ""), (0.0, "")]
        if -two[0][0] < 0.75:
            assert got[k].outcome in ("new", "invalid"), (no, two)
        else:
            assert (got[k].outcome, got[k].known_no, got[k].score) == ("ambiguous" if two[1][0] - two[0][0] < 0.08 else "similar", two[0][1], -two[0][0]), (no, two)


def test_what_is_left_without_characters(spark):
    got = spark.range(1).select(dossier.without(F.lit("abcd"), 2).alias("v"), dossier.without(F.lit("a"), 2).alias("w"), dossier.without(F.lit(""), 1).alias("x")).first()
    assert set(got.v) == {"abcd", "bcd", "acd", "abd", "abc", "ab", "ac", "ad", "bc", "bd", "cd"} and got.w == ["a", ""] and got.x == [""]


def test_stream_dedupe_equals_batch(spark, sf, tmp_path):
    stream = jobs.deduplicated(jobs.events(spark, sf), ["user_id"], "3650 days")
    got = jobs.run(stream, "append", str(tmp_path / "c")).select("user_id").collect()
    want = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()
    assert sorted(got) == sorted(want)
