"""What a step costs at size: expressions that are made once, sides that aren't read, files that stay."""

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import joins, recon
from quillon.sources import tables as t

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spaces_are_what_java_calls_white_space(spark):
    every = spark.createDataFrame([(chr(k),) for k in range(1, 0xD800)], "c string")
    found = every.filter(F.regexp_like("c", F.lit(r"(?U)\s"))).collect()
    assert {r.c for r in found} == set(text.SPACES) and len(set(text.SPACES)) == len(text.SPACES)


def test_numbers_are_made_without_lambdas_and_once(spark):
    docs = spark.createDataFrame([("a", " cg（DD） -1）"), ("b", "(DD)"), ("c", "x(1)(2)y"), ("d", None), ("e", "())")], "id string, no string")
    got = {r.id: r.v for r in docs.select("id", text.contract_variants(F.col("no")).alias("v")).collect()}
    assert got == {"a": ["CG(DD)-1", "CG-1"], "b": ["(DD"], "c": ["X(1)(2)Y", "XY"], "d": [], "e": ["("]}
    lines = spark.createDataFrame([("l", "CG(DD)-1", "CG-1"), ("m", "XY", "")], "line string, up string, down string")
    pairs = joins.variant_join(docs, lines, ["no"], ["up", "down"], "id", "line")
    assert sorted(map(tuple, pairs.collect())) == [("a", "l"), ("c", "m")]
    assert "lambda" not in plan_of(pairs) and "size(array_distinct" not in plan_of(pairs)


def test_names_that_nothing_reads_are_not_joined(spark):
    lines, docs = t.ledger(spark, SF), t.line_documents(spark, SF)
    assert "Join" not in plan_of(docs.drop("seller")) and "Join" in plan_of(docs)
    assert "Join" not in plan_of(lines.drop("customer", "segment")) and "Join" in plan_of(lines)
    assert plan_of(recon.r5_membership(lines, docs, ["up_contract_no"])).count("Join") == 1


def test_files_of_shuffles_and_of_steps_go(spark):
    """Of binding two tables stay: the one it returns and nothing else, and no shuffle's files."""
    from pathlib import Path

    from quillon.sources.shared import CLEANUP, shared_dir

    top = Path(shared_dir(spark).removeprefix("file://"))
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString())
    files = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    lines = spark.createDataFrame([("1", "CG-1", "XS-1", "Works-1 Ltd", "Client-1 Ltd", "MV1X", 10)], "business_no string, up_contract_no string, down_contract_no string, supplier string, customer string, vessel string, up_settlement int")
    docs = spark.createDataFrame([("a", "CG-1", "unknown", "invoice", 5, "", "", ""), ("b", "", "unknown", "invoice", 10, "", "", ""), ("c", "", "unknown", "invoice", None, "Works-1 Ltd", "", "")], "document_id string, contract_no string, direction string, role string, amount int, seller string, company string, text string")
    before, old = files(), {p.name for p in top.glob("*")} if top.exists() else set()
    bound, pool = recon.bind(lines, docs, ["up_contract_no"], ["down_contract_no"])
    assert {r.document_id: r.basis for r in bound.collect()} == {"a": "number", "b": "amount", "c": "party"}
    assert [p.name.split("-")[0] for p in top.glob("*") if p.name not in old] == ["bound"]
    assert spark.conf.get(CLEANUP) == "false"
    recon.written(docs.repartition(3, "document_id").groupBy("document_id").count(), "counted")
    assert not [f for f in files() - before if f]


def test_small_files_share_tasks(spark, tmp_path):
    from quillon.sources import files, pictures

    for k in range(200):
        (tmp_path / f"{k}.png").write_bytes(pictures.png(1, 1, 1, bytes([k])))
    most = files.TASKS * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # one file to a task
    try:
        rows = pictures.scan(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() <= most < 200 and rows.count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_letters_become_digits_in_one_pass(spark):
    """As many patterns as it takes, none of which begins by looking back over many lengths, and what a pass for each letter gives."""
    def slow(c):
        like = text.LIKE
        for letters, digit in text.LETTERS.items():
            c = F.regexp_replace(c, rf"(?<=\d[{like}]{{0,40}})[{letters}](?=[{like}]{{0,40}}\d)", digit)
        c = F.regexp_replace(c, rf"(?<=[¥￥])[ \t]+(?=[{like}\d])", "")
        for letters, digit in text.LETTERS.items():
            c = F.regexp_replace(c, rf"(?<=[¥￥][{like}\d]{{0,40}})[{letters}]", digit)
        return c

    def slow_invoice(c):
        for letters, digit in text.LETTERS.items():
            c = F.regexp_replace(c, rf"(?<=(?:发票号码|发票号|发票代码|代码)[:：]?[ \t]{{0,8}}[0-9A-Za-z\-_/]{{0,30}})[{letters}]", digit)
        return c

    runs = ["".join("OIlsSBbGgZzTt"[(k * 7 + n) % 13] for k in range(n)) for n in (1, 2, 3, 39, 40, 41, 42, 43, 60, 80, 81, 82, 83, 90)]
    values = [None, "", "1O0,5S0", "O1", "¥ 1O0,5S0.00 元", "￥\tOOx5S", "¥x1S", "losses in 2O26 total", "1\nO2", "1😀O2 ¥😀S", "\x01O 1O2 \x01", "发票号：2O\t代码 ABOS-_/Is", "发票代码" + "O" * 35, "代码:" + " " * 9 + "O", *[a + r + b for r in runs for a in ("", "1", "¥", "代码: ") for b in ("", "2", "x2")]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v string")
    v = F.coalesce("v", F.lit(""))
    got = rows.select(text.repair_digits(v).alias("a"), slow(v).alias("b"), text.repair_invoice_no(v).alias("c"), slow_invoice(v).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    assert {"100,550", "¥100,550.00 元", "losses in 2026 total"} <= {r.a for r in got}
    assert plan_of(rows.select(text.repair_invoice_no(v).alias("x"))).count("regexp_replace(") == 1


def test_texts_without_dates_and_amounts_skip_them(spark):
    """The same texts as by every step, and the steps of dates and amounts behind a condition."""

    def whole(c):
        lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"\n{3,}", "\n\n")
        spaces = F.regexp_replace(F.translate(lines, "　", " "), r"[ \t]+", " ")
        return F.regexp_replace(text.normal_amounts(text.normal_dates(text.fold_repeats(spaces))), r"(?U)^\s+|\s+$", "")

    values = [None, "", " \u3000\xa0\n", "a  b\tc \t d　e　　f", "x\r\n\r\n\r\n\ry !!!!!\u2028", "2026-6-8", "on 2026/6/8.", "2026 . 6", "2026年6月8日", "２０２６年６月８日", "2026年6月", "1,000 元", "RMB 1,0", "人民币\t2,000.5", "¥3,0", "￥ 4,0元",
              "a\x01b", "a\x02b", "20000000-1-1", "5555555.5.5 b", "plain words, 12-3 and 1.5", "\t\ta\t\t", "😀😀😀😀😀 \t"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v string")
    got = rows.select("v", text.clean_text(F.col("v")).alias("a"), whole(F.col("v")).alias("b")).collect()
    assert [(r.v, r.a) for r in got] == [(r.v, r.b) for r in got]
    plan = plan_of(rows.select(text.clean_text(F.col("v")).alias("x")))
    assert "CASE WHEN" in plan


def test_texts_of_numbers_are_made_in_many_tasks(spark, monkeypatch):
    """Numbers come in one small file; their texts, some hundreds each, are not made by its task alone."""
    from quillon.operators import dossier

    made, whole = [], dossier.spread
    monkeypatch.setattr(dossier, "SPREAD", 10)
    monkeypatch.setattr(dossier, "spread", lambda df: (made.append(whole(df)), made[-1])[1])
    known = spark.createDataFrame([(f"HSYCXS-2026-{k:04d}",) for k in range(45)], "no string").coalesce(1)
    asked = spark.createDataFrame([(1, "H5YCXS-2026-0007"), (2, "HSYCXS-2026-0007"), (3, "none")], "id int, no string")
    got = {r.id: (r.outcome, r.known_no) for r in dossier.fuzzy_guard(asked, known, "no", "id").collect()}
    assert got == {1: ("ambiguous", "HSYCXS-2026-0007"), 2: ("linked", "HSYCXS-2026-0007"), 3: ("invalid", None)}
    assert max(df.rdd.getNumPartitions() for df in made) == 5


def test_grams_of_samples_are_not_shuffled(spark, monkeypatch):
    from quillon.operators import rules

    monkeypatch.setattr(rules, "SAMPLES", 2)
    docs = spark.createDataFrame([(1, "the the"), (2, None), (3, "abab"), (None, "the the"), (5, ""), (6, "de the de")], "id int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = rules.learned_sample(docs, "id", "text", ["the", "de"], "[a-z]", "", 50)
        assert got.rdd.getNumPartitions() == 4
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
        rows = {r.id: (r.labels, r.grams) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {1: ({"the": 2}, {"he": 2, "th": 2}), 2: ({}, {}), 3: ({}, {"ab": 2}), None: ({}, {}), 5: ({}, {}), 6: ({"de": 2, "the": 1}, {"de": 2})}


def test_lines_are_not_read_for_documents_that_nothing_waits_for(spark):
    lines = spark.createDataFrame([("1", 10)], "business_no string, up_settlement int").withColumn("business_no", F.raise_error(F.lit("lines are read")).cast("string"))
    docs = spark.createDataFrame([("a", "1", "up", "invoice", 5), ("b", "1", "unknown", "other", 5), ("c", "1", None, "invoice", 5)], "document_id string, business_no string, direction string, role string, amount int")
    assert sorted(map(tuple, recon.assign(lines, docs).collect())) == sorted(map(tuple, docs.collect()))


def test_only_what_is_read_of_differences_is_made(spark):
    lines, docs = t.ledger(spark, SF), t.line_documents(spark, SF)
    numbers = ["up_contract_no", "down_contract_no"]
    few, whole = recon.differences(lines, docs, numbers, read=["severity", "role"]), recon.differences(lines, docs, numbers)
    assert few.columns == ["business_no", "severity", "role"]
    assert "goods only" not in plan_of(few) and "collect_list(CASE" not in plan_of(few) and "goods only" in plan_of(whole)
    rows = lambda df: sorted(map(tuple, df.select(*few.columns).collect()))
    assert rows(few) == rows(whole)
    assert recon.differences(lines, docs, numbers, read=["key"]).select("key").exceptAll(whole.select("key")).isEmpty()


def test_names_of_cargo_are_made_once(spark):
    lines = spark.createDataFrame([("1", "MV1", "Client-1", "Works-1"), ("2", "MV2", "Client-2", "Works-2")], "business_no string, vessel string, customer string, supplier string")
    docs = spark.createDataFrame([("a", "cargo_right", "船名 MV1，货物转移给Client-1有限公司。"), ("b", "cargo_right", "船名 MV2，货物转移给云创有限公司。"), ("c", "cargo_right", "船名 MV2，货物转移给X有限公司。"), ("d", "invoice", "MV1")], "document_id string, role string, text string")
    found = recon.cargo_reach(docs, lines)
    assert {r.document_id: (r.lo, r.hi, r.way.direction) for r in found.collect()} == {"a": ("1", "1", "down"), "b": ("2", "2", "up")}
    asked = [line for line in plan_of(found).splitlines() if "CASE WHEN" in line]
    assert asked and not any("regexp" in line or "translate" in line for line in asked)


def test_differences_are_written_rule_by_rule(spark, monkeypatch):
    """A rule's shuffles end before the next one's begin; keys, which other columns give, are not written."""
    from quillon.plans import linking

    made, write = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df, name: (made.append(df.columns), write(df, name))[1])
    out = linking.recon_diffs(spark, SF)
    assert len(made) >= 6 and all(columns == recon.DIFF for columns in made)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    whole = linking.flat(linking.found(spark, SF)[2])
    assert out.columns == whole.columns and out.exceptAll(whole).isEmpty() and whole.exceptAll(out).isEmpty()
