"""Workbooks and word files as streams of rows, from their zipped XML, and workbooks written the same way.

Sheets are read row by row, so a sheet of any length takes the memory of its shared strings and one row; writers hold one row.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import IO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

#: XML names of the office formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats of dates that workbooks need not declare.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_CODE = re.compile(r"[dmyhs]", re.IGNORECASE)
UNQUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', re.IGNORECASE)
#: Most characters of a cell, and most rows of a sheet, that the format allows.
MOST_CHARS, MOST_ROWS = 32_767, 1_048_576
#: An empty cell.
NOTHING = ("s", "")
BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


class DamagedFile(ValueError):
    """The file isn't a zipped document of the expected kind."""


def column(reference: str) -> int:
    """The column of a cell's name from 0: A1 is 0, AB7 is 27."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(k: int) -> str:
    out = ""
    while k >= 0:
        k, rest = divmod(k, 26)
        out, k = chr(65 + rest) + out, k - 1
    return out


def is_date(code: str) -> bool:
    """Whether a number format shows a day or a time; quoted text, colours and conditions aside."""
    return bool(DATE_CODE.search(UNQUOTED.sub("", code.split(";")[0])))


def shown(value: float) -> str:
    """A number as text, without a fraction if it has none."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def shown_day(serial: float, epoch: datetime) -> str:
    """A day number as ISO text, with the time unless it is midnight; a number below 1 is a time."""
    at = epoch + timedelta(seconds=round(serial * 86400))
    if 0 <= serial < 1:
        return at.strftime("%H:%M:%S")
    if epoch.year == 1899 and serial < 60:  # the format counts a 29 February 1900 that wasn't
        at += timedelta(days=1)
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def ended(part: IO[bytes], tags: set[str], within: str) -> Iterator[ET.Element]:
    """Each element of these tags as it ends.  What stands directly in a `within` is forgotten afterwards, so a long file
    takes no more memory than a short one."""
    around = None
    for event, node in ET.iterparse(part, ("start", "end")):
        if event == "start":
            around = node if node.tag == within else around
        elif node.tag in tags:
            yield node
            if around is not None and node is not around:
                around.clear()


class Workbook:
    """A workbook's sheets, and their rows as (kind, text): n a number, d a day, t a time, b TRUE or FALSE, e an error, s a text."""

    def __init__(self, file: IO[bytes]):
        try:
            self.zip = zipfile.ZipFile(file)
            book = ET.fromstring(self.zip.read("xl/workbook.xml"))
            links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError) as e:  # ValueError: a seek before the start
            raise DamagedFile(f"not a workbook: {e}") from e
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(links[s.get(f"{LINK}id")]) for s in book.iter(f"{MAIN}sheet") if s.get(f"{LINK}id") in links}
        properties = book.find(f"{MAIN}workbookPr")
        self.epoch = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self._strings: list[str] | None = None
        self._dates: list[bool] | None = None

    def part(self, name: str) -> IO[bytes] | None:
        return self.zip.open(name) if name in self.zip.NameToInfo else None

    @property
    def strings(self) -> list[str]:
        """Texts that cells share; phonetic hints are no part of them."""
        if self._strings is None:
            self._strings = []
            if part := self.part("xl/sharedStrings.xml"):
                self._strings += map(text_of, ended(part, {f"{MAIN}si"}, f"{MAIN}sst"))
        return self._strings

    @property
    def dates(self) -> list[bool]:
        """For each cell style whether it shows a date."""
        if self._dates is None:
            self._dates = []
            if part := self.part("xl/styles.xml"):
                root = ET.parse(part).getroot()
                own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{MAIN}numFmt")}
                styles = root.find(f"{MAIN}cellXfs")
                ids = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
                self._dates = [is_date(own[i]) if i in own else i in DATES for i in ids]
        return self._dates

    def cell(self, node: ET.Element) -> tuple[str, str]:
        kind, value = node.get("t", "n"), node.find(f"{MAIN}v")
        if kind == "inlineStr":
            inner = node.find(f"{MAIN}is")
            return "s", text_of(inner) if inner is not None else ""
        raw = value.text if value is not None else None
        if not raw:
            return NOTHING
        if kind == "s":
            return "s", self.strings[int(raw)]
        if kind == "b":
            return "b", "TRUE" if raw in ("1", "true") else "FALSE"
        if kind in ("str", "e", "d"):
            return {"str": "s", "e": "e", "d": "d"}[kind], raw
        style, number = int(node.get("s", 0)), float(raw)
        if style < len(self.dates) and self.dates[style] and 0 <= number < 2_958_466:
            text = shown_day(number, self.epoch)
            return "d" if len(text) == 10 else "t", text
        return "n", shown(number)

    def merged(self, sheet: str) -> list[tuple[int, int, int, int]]:
        """Merged areas as (first row, first column, last row, last column), rows from 1; they stand behind the rows."""
        out = []
        for node in ended(self.zip.open(self.sheets[sheet]), {f"{MAIN}mergeCell", f"{MAIN}row"}, f"{MAIN}sheetData"):
            if node.tag == f"{MAIN}mergeCell":
                a, _, b = node.get("ref").partition(":")
                out.append((int(re.sub(r"\D", "", a)), column(a), int(re.sub(r"\D", "", b or a)), column(b or a)))
        return out

    def rows(self, sheet: str, fill: bool = False) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """(number of the row from 1, cells) of the rows that the sheet holds, as wide as the sheet says it is; with `fill` every
        cell of a merged area has the area's value, else only its first."""
        areas = self.merged(sheet) if fill else []
        open_: list[tuple[tuple[int, int, int, int], tuple[str, str]]] = []
        width, last = 0, 0
        for node in ended(self.zip.open(self.sheets[sheet]), {f"{MAIN}dimension", f"{MAIN}row"}, f"{MAIN}sheetData"):
            if node.tag == f"{MAIN}dimension":
                width = column(node.get("ref", "A1").partition(":")[2] or "A1") + 1
                continue
            last = number = int(node.get("r", last + 1))
            cells: list[tuple[str, str]] = []
            for c in node.iter(f"{MAIN}c"):
                at = column(c.get("r")) if c.get("r") else len(cells)
                cells += [NOTHING] * (at + 1 - len(cells))
                cells[at] = self.cell(c)
            cells += [NOTHING] * (width - len(cells))
            if areas:
                open_ = [(a, t) for a, t in open_ if a[2] >= number] + [(a, cells[a[1]] if a[1] < len(cells) else NOTHING) for a in areas if a[0] == number]
                for (_, left, _, right), value in open_:
                    cells += [NOTHING] * (right + 1 - len(cells))
                    cells[left : right + 1] = [value] * (right + 1 - left)
            yield number, cells


def text_of(node: ET.Element) -> str:
    """The text of a shared or inline string: its own, and that of its runs."""
    return "".join(t.text or "" for r in node if r.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([r] if r.tag == f"{MAIN}t" else r.iter(f"{MAIN}t")))


class SheetWriter:
    """Writes one workbook; the sheets come one after another, and the rows of each in order."""

    def __init__(self, file: IO[bytes]):
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        self.names: list[str] = []
        self.part: IO[bytes] | None = None
        self.row = 0

    def sheet(self, name: str) -> None:
        """Begins a sheet; names are at most 31 characters without []:*?/\\, and of equal names the later get a number."""
        self.end()
        plain = re.sub(r"[\[\]:*?/\\]", " ", name)[:31] or "Sheet"
        taken, k, own = {n.lower() for n in self.names}, 1, plain
        while own.lower() in taken:
            k += 1
            own = f"{plain[: 31 - len(f' ({k})')]} ({k})"
        self.names.append(own)
        self.part, self.row = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), 0
        self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())

    def add(self, cells: list[tuple[str | None, str | None]]) -> None:
        """A row of (kind, value): n a number, d and t a day's or time's serial number, b 0 or 1, s a text, and None nothing."""
        self.row += 1
        if self.row > MOST_ROWS:
            raise ValueError(f"a sheet has {MOST_ROWS} rows at most")
        out = []
        for k, (kind, value) in enumerate(cells):
            at = f'r="{column_name(k)}{self.row}"'
            if kind is None or value is None:
                continue
            if kind == "s":
                text = BAD.sub("", value)
                if len(text) > MOST_CHARS:
                    raise ValueError(f"a cell has {MOST_CHARS} characters at most; this one has {len(text)}")
                out.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
            elif kind == "b":
                out.append(f'<c {at} t="b"><v>{value}</v></c>')
            else:
                style = {"d": ' s="1"', "t": ' s="2"'}.get(kind, "")
                out.append(f"<c {at}{style}><v>{value}</v></c>")
        self.part.write(f'<row r="{self.row}">{"".join(out)}</row>'.encode())

    def end(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def close(self) -> None:
        if not self.names:
            self.sheet("Sheet")
        self.end()
        head, kind, place = '<?xml version="1.0" encoding="UTF-8"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml", LINK[1:-1]
        n = range(1, len(self.names) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n)
        sheets = "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, x in zip(n, self.names, strict=True))
        links = "".join(f'<Relationship Id="rId{k}" Type="{place}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
        package = "http://schemas.openxmlformats.org/package/2006"
        styles = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs>'
        for name, body in {
            "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>',
            "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{place}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{place}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(self.names) + 1}" Type="{place}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'{head}<styleSheet xmlns="{MAIN[1:-1]}">{styles}</styleSheet>',
        }.items():
            self.zip.writestr(name, body)
        self.zip.close()


# Word files


def run_text(node: ET.Element) -> str:
    """The text of a paragraph or run, tabs and breaks included; deleted text and field codes aside."""
    out = []
    for x in node.iter():
        if x.tag == f"{WORD}t":
            out.append(x.text or "")
        elif x.tag == f"{WORD}tab":
            out.append("\t" if x.get(f"{WORD}val") is None else "")  # a tab stop of the style has a value
        elif x.tag in (f"{WORD}br", f"{WORD}cr"):
            out.append("\n")
        elif x.tag == f"{WORD}noBreakHyphen":
            out.append("-")
    return "".join(out)


def grid(table: ET.Element) -> list[list[str]]:
    """A table's texts; a cell that spans columns or rows stands in each of them."""
    out: list[list[str]] = []
    for row in table.findall(f"{WORD}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{WORD}tc"):
            own = cell.find(f"{WORD}tcPr")
            span = own.find(f"{WORD}gridSpan") if own is not None else None
            merge = own.find(f"{WORD}vMerge") if own is not None else None
            text = " ".join("\n".join(run_text(p) for p in cell.findall(f"{WORD}p")).strip().split("\n"))
            if merge is not None and merge.get(f"{WORD}val", "continue") == "continue" and out and len(cells) < len(out[-1]):
                text = out[-1][len(cells)]
            cells += [text] * (int(span.get(f"{WORD}val", 1)) if span is not None else 1)
        out.append(cells)
    return out


def word_lines(file: IO[bytes], headings: tuple[str, ...] = ("heading", "标题")) -> tuple[list[str], list[list[list[str]]], int]:
    """SRC-05, FN-78: the lines of a word file in order (headers first, footers last, headings and tables marked), its tables, and its number
    of sections."""
    try:
        parts = zipfile.ZipFile(file)
        body = ET.fromstring(parts.read("word/document.xml")).find(f"{WORD}body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError) as e:  # ValueError: a seek before the start
        raise DamagedFile(f"not a word file: {e}") from e
    if body is None:
        raise DamagedFile("not a word file: it has no body")
    names = {}
    if "word/styles.xml" in parts.NameToInfo:
        for s in ET.fromstring(parts.read("word/styles.xml")).iter(f"{WORD}style"):
            name = s.find(f"{WORD}name")
            names[s.get(f"{WORD}styleId")] = name.get(f"{WORD}val", "").lower() if name is not None else ""
    links = {}
    if "word/_rels/document.xml.rels" in parts.NameToInfo:
        links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(parts.read("word/_rels/document.xml.rels"))}

    lines, tables = [], []
    for node in body:
        if node.tag == f"{WORD}p":
            if text := run_text(node).strip():
                style = node.find(f"{WORD}pPr/{WORD}pStyle")
                name = names.get(style.get(f"{WORD}val"), "") if style is not None else ""
                lines.append(f"[标题] {text}" if name.startswith(headings) else text)
        elif node.tag == f"{WORD}tbl":
            tables.append(grid(node))
            lines += ["[表格]", *(" | ".join(r) for r in tables[-1] if any(r))]

    sections = list(body.iter(f"{WORD}sectPr"))

    def margins(kind: str) -> list[str]:
        """Texts of each section's header or footer; a section without one has that of the section before."""
        out, target = [], None
        for s in sections:
            own = next((r.get(f"{LINK}id") for r in s.findall(f"{WORD}{kind}Reference") if r.get(f"{WORD}type", "default") == "default"), None)
            target = links.get(own, target)
            place = target and (target.lstrip("/") if target.startswith("/") else f"word/{target}")
            if place and place in parts.NameToInfo:
                out += [t for p in ET.fromstring(parts.read(place)).findall(f"{WORD}p") if (t := run_text(p).strip())]
        return out

    if top := margins("header"):
        lines.insert(0, "[页眉] " + " | ".join(top))
    if bottom := margins("footer"):
        lines.append("[页脚] " + " | ".join(bottom))
    return lines, tables, len(sections)
