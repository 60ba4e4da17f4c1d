"""Workbooks, word files, watched folders and archives, written and read as Spark formats."""

import datetime
import io
import json
import pickle
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import sinks
from quillon.sources import files, office, readers, store

MAIN = office.MAIN[1:-1]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def workbook(sheets, strings=(), styles="", properties=""):
    """A workbook of raw sheet XML, as other programs write them: shared strings, styles, gaps."""
    place = office.LINK[1:-1]
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{k}" Type="t" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{place}">{properties}<sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="p">{links}</Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{"".join(strings)}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>',
    }
    parts |= {f"xl/worksheets/s{k}.xml": f'<worksheet xmlns="{MAIN}">{body}</worksheet>' for k, body in enumerate(sheets.values(), 1)}
    return package(parts)


STYLES = '<numFmts><numFmt numFmtId="165" formatCode="yyyy&quot;年&quot;m&quot;月&quot;"/><numFmt numFmtId="166" formatCode="&quot;days&quot; 0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs>'
STRINGS = ["<si><t>船名</t></si>", "<si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si>"]
ROWS = """<dimension ref="A1:E6"/><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
<row r="3"><c r="A3"><v>45000</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3" s="2"><v>45000.5</v></c><c r="D3" s="3"><v>1.50</v></c><c r="E3" t="b"><v>1</v></c></row>
<row r="4"><c r="A4" t="str"><v>formula's</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="inlineStr"><is><t>in line</t></is></c><c r="D4"><v>1.0000000000000001E-5</v></c></row>
<row><c><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A3:A4"/><mergeCell ref="B4:C5"/></mergeCells>"""


def test_cells_of_a_workbook():
    book = office.Workbook(io.BytesIO(workbook({"one": ROWS, "two": "<sheetData/>"}, STRINGS, STYLES)))
    text = lambda fill: {n: [t for _, t in cells] for n, cells in book.rows("one", fill)}
    got = text(False)
    assert list(book.sheets) == ["one", "two"] and list(book.rows("two")) == []
    assert got[1] == ["船名", "", "two runs", "", ""]
    assert got[3] == ["45000", "2023-03-15", "2023-03-15 12:00:00", "1.5", "TRUE"]
    assert got[4] == ["formula's", "#N/A", "in line", "1e-05", ""] and got[5] == ["7", "", "", "", ""]
    filled = text(True)
    assert filled[4] == ["45000", "#N/A", "#N/A", "1e-05", ""] and filled[5] == ["7", "#N/A", "#N/A", "", ""]
    old = office.Workbook(io.BytesIO(workbook({"one": '<sheetData><row r="1"><c r="A1" s="1"><v>0.25</v></c><c r="B1" s="1"><v>1</v></c></row></sheetData>'}, (), STYLES, '<workbookPr date1904="1"/>')))
    assert [c for _, row in old.rows("one") for c in row] == [("t", "06:00:00"), ("d", "1904-01-02")]
    with pytest.raises(office.DamagedFile):
        office.Workbook(io.BytesIO(b"no zip"))


def test_names_of_columns_and_sheets():
    assert [office.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and office.column("AAA9") == 702
    assert office.is_date("m/d/yy") and office.is_date("[h]:mm") and not office.is_date('0.00 "d"') and not office.is_date("[Red]0.0") and not office.is_date("General")
    out = io.BytesIO()
    w = office.SheetWriter(out)
    for name in ("a/b", "a b", "x" * 40, "x" * 40):
        w.sheet(name)
    w.close()
    names = list(office.Workbook(io.BytesIO(out.getvalue())).sheets)
    assert names == ["a b", "a b (2)", "x" * 31, "x" * 27 + " (2)"]


def put(folder, name, data):
    with store.write(f"{folder}/{name}") as f:
        f.write(data)


def test_workbooks_as_a_format(spark, tmp_path):
    base = f"file://{tmp_path}/books"
    table = spark.createDataFrame(
        [(1, "x & <y>", 1.5, True, datetime.date(2026, 1, 2), datetime.datetime(2026, 1, 2, 3, 4, 5)), (2, " lead\n", -0.25, False, None, None), (None, None, None, None, None, None), (4, "007", float("nan"), None, datetime.date(1950, 5, 6), None)],
        "id long, `a name` string, amount double, flag boolean, day date, at timestamp_ntz",
    )
    sinks.write_workbooks({"list": table}, base, files=2)
    got = spark.read.format("workbook").load(base)
    assert dict(got.dtypes) == {"id": "bigint", "a name": "string", "amount": "string", "flag": "boolean", "day": "date", "at": "timestamp_ntz"}
    typed = spark.read.format("workbook").schema("id int, amount double, day date, `a name` string, missing int").load(base)
    assert sorted((r.id, r.amount, r.day, r["a name"], r.missing) for r in typed.collect() if r.id != 4) == [(1, 1.5, datetime.date(2026, 1, 2), "x & <y>", None), (2, -0.25, None, " lead\n", None)]
    assert typed.filter("id = 4").first()["a name"] == "007"
    sinks.write_workbooks({"list": table.limit(1)}, base, mode="overwrite")
    assert spark.read.format("workbook").load(base).count() == 1
    with pytest.raises(Exception, match="no sheet with a header"):
        spark.read.format("workbook").load(f"file://{tmp_path}/nothing")


def test_sheets_headers_and_damage(spark, tmp_path):
    base = f"file://{tmp_path}/books"
    rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{a}</t></is></c><c r="B{k}" t="inlineStr"><is><t>{b}</t></is></c></row>' for k, (a, b) in enumerate([("title", ""), ("船名", "数量"), ("海兴", "12"), ("", ""), ("明珠", "13")], 1))
    put(base, "a.xlsx", workbook({"cover": "<sheetData/>", "销售合同2026": f"<sheetData>{rows}</sheetData>"}))
    put(base, "~$a.xlsx", b"lock")
    put(base, "notes.txt", b"no workbook")
    readers.register(spark)
    read = lambda **o: spark.read.format("workbook").options(**o).load(base)
    got = read(sheet="销售合同", headerRow="auto")
    assert got.columns == ["船名", "数量"] and sorted(map(tuple, got.collect())) == [("明珠", "13"), ("海兴", "12")]
    assert read(sheet="销售合同", headerRow="3").columns == ["海兴", "12"]
    put(base, "b.xlsx", b"damaged")
    with pytest.raises(Exception, match="b.xlsx"):
        read(mode="cells").count()
    cells = read(mode="cells", onError="skip", partitionBytes="1")
    assert cells.filter("row = 2").first().cells == ["船名", "数量"] and cells.select("path").distinct().count() == 1
    text = sinks.workbook_texts(cells, most=3).first()
    assert text.text == "Sheet: 销售合同2026\ntitle | \n船名 | 数量\n海兴 | 12\n…（已截断，该表超过 3 行）" and text.tables == [[["title", ""], ["船名", "数量"], ["海兴", "12"]]]


def test_reports_are_one_workbook(spark, tmp_path):
    base = f"file://{tmp_path}/report"
    sinks.write_workbooks({"lines": spark.range(5).toDF("n"), "differences": spark.range(3).selectExpr("id", "array(id) AS ids"), "none": spark.range(0).toDF("k")}, base, files=1)
    cells = sinks.cells_of(spark, base)
    got = {(r.sheet, r.row): r.cells for r in cells.collect()}
    assert cells.select("path").distinct().count() == 1 and got["lines", 1] == ["n"] and got["differences", 1] == ["id", "ids"]
    assert sorted(v[0] for (s, n), v in got.items() if s == "lines" and n > 1) == ["0", "1", "2", "3", "4"] and got["differences", 2][1] == "[0]"


WORD = office.WORD[1:-1]


def test_word_files(spark, tmp_path):
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    tc = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(text)}</w:tc>"
    table = f'<w:tbl><w:tr>{tc("a", "<w:gridSpan w:val=%s/>" % (chr(34) + "2" + chr(34)))}{tc("b", "<w:vMerge w:val=%s/>" % (chr(34) + "restart" + chr(34)))}</w:tr><w:tr>{tc("c")}{tc("d")}{tc("", "<w:vMerge/>")}</w:tr><w:tr>{tc("")}{tc("")}{tc("")}</w:tr></w:tbl>'
    body = f'{p("标题一", "h1")}{p("  ")}<w:p><w:r><w:t>left</w:t><w:tab/><w:t>right</w:t><w:br/></w:r></w:p>{table}<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr></w:pPr></w:p>{p("end")}<w:sectPr><w:footerReference w:type="default" r:id="f"/></w:sectPr>'
    ns = f'xmlns:w="{WORD}" xmlns:r="{office.LINK[1:-1]}"'
    data = package({
        "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {ns}><w:style w:styleId="h1"><w:name w:val="Heading 1"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="p"><Relationship Id="h" Target="header1.xml"/><Relationship Id="f" Target="footer1.xml"/></Relationships>',
        "word/header1.xml": f"<w:hdr {ns}>{p('top')}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {ns}>{p('bottom')}</w:ftr>",
    })
    base = f"file://{tmp_path}/words"
    put(base, "a.docx", data)
    put(base, "b.docx", b"damaged")
    readers.register(spark)
    good, bad = spark.read.format("word").load(base).orderBy("path").collect()
    assert good.lines == ["[页眉] top | top", "[标题] 标题一", "left\tright", "[表格]", "a | a | b", "c | d | b", "end", "[页脚] bottom"]
    assert good.tables == [[["a", "a", "b"], ["c", "d", "b"], ["", "", ""]]] and good.sections == 2 and good.text.startswith("[页眉]")
    assert bad.text is None and bad.error.startswith("not a word file")


def drained(spark, base, work):
    """What one run over what there is now has found."""
    out = f"{work}/rows"
    readers.register(spark)
    stream = spark.readStream.format("folder").option("state", f"{work}/state").load(base)
    before = spark.read.parquet(out).count() if store.exists(out) else 0
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) >= before
    return sorted((r.name, r.version, bytes(r.content) if r.content is not None else None, r.error) for r in rows)


def test_folder_gives_each_version_once(spark, tmp_path):
    base, work = f"file://{tmp_path}/in", f"file://{tmp_path}/work"
    put(base, "a.txt", b"one")
    put(base, "b.csv", b"x,y")
    put(base, ".hidden.txt", b"")
    put(base, "~$lock.xlsx", b"")
    put(base, "c.unknown", b"")
    put(base, "below/d.txt", b"not looked at")
    first = [("a.txt", 1, b"one", None), ("b.csv", 1, b"x,y", None)]
    assert drained(spark, base, work) == first
    assert drained(spark, base, work) == first  # nothing has changed
    put(base, "a.txt", b"longer")
    store.delete(f"{base}/b.csv")
    second = sorted([*first, ("a.txt", 2, b"longer", None)])
    assert drained(spark, base, work) == second
    put(base, "b.csv", b"x,y")
    assert drained(spark, base, work) == sorted([*second, ("b.csv", 3, b"x,y", None)])


def test_looks_are_never_lost(tmp_path):
    """A look that no batch has taken yet belongs to the next one, and a file that comes after it to the next look."""
    base, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    options = {"path": base, "state": state, "partitionBytes": "4"}
    put(base, "a.txt", b"1234")
    assert readers.FolderStream(options).latestOffset() == {"entry": 1}
    for k in range(2, 26):
        put(base, f"f{k}.txt", b"12")
        again = readers.FolderStream(options)  # after a restart
        assert again.latestOffset() == {"entry": k} and again.latestOffset() == {"entry": k}
    names = lambda a, b: [f[0].rpartition("/")[2] for p in readers.FolderStream(options).partitions({"entry": a}, {"entry": b}) for f in p.files]
    assert names(0, 3) == ["a.txt", "f2.txt", "f3.txt"] and names(24, 25) == ["f25.txt"] and names(3, 3) == []
    assert len(readers.FolderStream(options).partitions({"entry": 0}, {"entry": 3})) == 2
    store.delete(f"{base}/a.txt")
    gone = readers.FolderStream(options).partitions({"entry": 0}, {"entry": 1})[0]
    assert next(readers.FolderStream(options).read(gone))[-1] == "the file is gone"


def test_archive(spark, tmp_path):
    base = f"file://{tmp_path}/archive"
    docs = spark.createDataFrame([(1, "x", "a.txt", "one"), (2, "x", "a.txt", "two"), (3, "y/z", "a.txt", "three"), (4, "x", "a_001.txt", "four"), (5, "", "b", None)], "id long, dir string, name string, text string").repartition(3)
    where = sinks.archived(docs, base, F.col("dir"), F.col("name"), F.col("text"))
    assert {r.id: (r.directory, r.filename) for r in where.collect()} == {1: ("x", "a.txt"), 2: ("x", "a_002.txt"), 3: ("y/z", "a.txt"), 4: ("x", "a_001.txt"), 5: ("", "b")}
    contents = {f.uri[len(base) + 1 :]: store.read(f.uri).read() for f in store.files(base)}
    assert contents == {"x/a.txt": b"one", "x/a_002.txt": b"two", "y/z/a.txt": b"three", "x/a_001.txt": b"four", "b": b""}
    more = sinks.archived(docs.filter("id < 3"), base, F.col("dir"), F.col("name"), F.col("text"))
    assert {r.id: r.filename for r in more.collect()} == {1: "a_003.txt", 2: "a_004.txt"}


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/archive"
    readers.register(spark)
    rows = spark.range(40, numPartitions=4).selectExpr("'d' AS directory", "concat('f', id) AS filename", "cast('x' AS binary) AS content")
    failing = rows.withColumn("content", F.when(F.col("filename") == "f39", F.raise_error(F.lit("injected")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="injected"):
        failing.write.format("archive").mode("append").save(base)
    assert store.files(base) == []
    rows.limit(2).write.format("archive").mode("append").save(base)
    with pytest.raises(Exception, match="f0"):  # a name is taken: none of the forty comes
        rows.write.format("archive").mode("append").save(base)
    assert [f.name for f in store.files(base)] == ["f0", "f1"]
    with pytest.raises(Exception, match="not a place"):
        rows.limit(1).withColumn("directory", F.lit("..")).write.format("archive").mode("append").save(base)
    with pytest.raises(Exception, match="32767 characters"):
        sinks.write_workbooks({"s": spark.createDataFrame([("x" * 40_000,)], "t string")}, base)
    assert [f.name for f in store.files(base)] == ["f0", "f1"]


def test_a_failed_move_is_taken_back(tmp_path, monkeypatch):
    base = f"file://{tmp_path}/archive"
    writer = readers.ArchiveWriter({"path": base})
    for k in range(3):
        put(writer.aside, f"t/{k}", b"x")
    moved, plain = [], store.move

    def move(a, b):
        if len(moved) == 2:
            moved.append(b)
            raise OSError("the store is full")
        moved.append(b)
        plain(a, b)

    monkeypatch.setattr(store, "move", move)
    with pytest.raises(OSError, match="full"):
        writer.commit([readers.Written([(f"{writer.aside}/t/{k}", f"{base}/{k}") for k in range(3)]), None])
    writer.abort([])
    assert store.files(base) == []


def test_sheets_stay_whole_when_a_task_has_more_rows_than_a_file(spark, sf, monkeypatch):
    """Each file begins with its header, however many rows one task writes."""
    import parity

    from quillon import plans
    from quillon.plans import files

    monkeypatch.setattr(files, "SHEET", 100)
    monkeypatch.setattr(files, "WORKBOOK", 150)
    parity.check(spark, parity.connection(sf), sf, plans.QUERIES["workbook_configured"], plans.SQL["workbook_configured"])


def test_an_archive_is_not_held_by_the_driver(spark, tmp_path, monkeypatch):
    """Tasks note the files that commit moves, and list those that are there: neither comes to the driver as a whole."""
    monkeypatch.setattr(store, "files", lambda *a, **k: pytest.fail("all files are listed at once"))
    base = f"file://{tmp_path}/archive"
    docs = spark.range(50, numPartitions=3).selectExpr("id", "concat('d', id % 4) AS dir", "concat('é ', id) AS text")
    for _ in range(2):
        sinks.archived(docs, base, F.col("dir"), F.lit("a.txt"), F.col("text"))
    found = files.contents(files.listing(spark, base))
    got = [(r.path[len(base) + 1 :].partition("/")[0], bytes(r.content).decode()) for r in found.collect()]
    assert sorted(got) == sorted([(f"d{k % 4}", f"é {k}") for k in range(50)] * 2)
    assert {r.filename for r in sinks.existing(spark, base).filter("directory = 'd1'").collect()} == {"a.txt", *[f"a_{k:03d}.txt" for k in range(1, 26)]}
    writer = readers.ArchiveWriter({"path": base})
    put(writer.aside, "0/files", b"".join(json.dumps([f"{writer.aside}/0/{k}", f"{base}/x/{k % 2}"]).encode() + b"\n" for k in range(3)))
    message = readers.Noted(f"{writer.aside}/0/files")
    assert len(pickle.dumps(message)) < 300
    for k in range(3):
        put(writer.aside, f"0/{k}", b"x")
    with pytest.raises(FileExistsError, match="occurs twice.*x/0"):
        writer.commit([message])
    assert not store.exists(f"{base}/x")


def test_many_moves_are_taken_back(tmp_path, monkeypatch):
    """The last of several parts fails: those of all go back."""
    monkeypatch.setattr(readers, "TAKEN", 2)
    monkeypatch.setattr(readers, "MOVERS", 2)
    base = f"file://{tmp_path}/archive"
    writer = readers.ArchiveWriter({"path": base})
    for k in range(11):
        put(writer.aside, f"t/{k}", b"x")
    pairs = [(f"{writer.aside}/t/{k}", f"{base}/d/{k}") for k in range(11)]
    with pytest.raises(FileNotFoundError):
        writer.commit([readers.Written(pairs), readers.Written([(f"{writer.aside}/t/none", f"{base}/d/none")])])
    assert {f.uri for f in store.files(base)} == {s for s, _ in pairs}
    writer.commit([readers.Written(pairs)])
    assert {f.uri for f in store.files(base)} == {t for _, t in pairs}
