"""Formats for spark.read, df.write and spark.readStream: workbooks, word files, watched folders, archives (SRC-05, SRC-06, SRC-10, SRC-12,
SRC-17, SNK-01, SNK-03, SNK-12, STR-01).

register(spark) makes them known.  The driver lists files and plans partitions; the tasks open, parse and write them.

`workbook`     A row for each row of a sheet.  With mode=cells: path, sheet, place (of the sheet, from 0), row, cells (array of texts).  Otherwise the columns that
               the header names, their kinds inferred from the first rows of the first files, or those of the given schema.
               Options: sheet (exact, else the first that holds the name or is held by it; default: the first), headerRow
               (a number from 1, or auto: the first of ten rows with two mapped columns), merged (first or fill), partitionBytes,
               inferRows, onError (fail, or skip damaged files).
`workbook` as a sink takes rows of (sheet, header, cells), see sinks.workbook_rows; rowsPerFile bounds a file; with
               wholeSheets a file ends only where a sheet does.
`word`         path, text, lines, tables, sections, error of each word file.
`folder`       A stream of the files of a folder, each version (path, size, time) once; see FolderStream.
`archive`      A sink of (directory, filename, content): one file for each row, all published or none.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from itertools import islice

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.ledger import header_row
from . import store
from .files import KINDS
from .office import DamagedFile, SheetWriter, Workbook, word_lines
from .workbook import sheet_named

#: Moves that a commit has under way at once, those of a local store, where more hinder each other, and files that one thread takes together.
MOVERS, LOCAL_MOVERS, TAKEN = 16, 4, 1000
CELLS = "path string, sheet string, place int, row int, cells array<string>"
SHEET_ROWS = "sheet string, header array<string>, cells array<struct<t:string,v:string>>"
WORDS = "path string, text string, lines array<string>, tables array<array<array<string>>>, sections int, error string"
VERSIONS = "path string, name string, kind string, size long, modified_at timestamp, version long, content binary, error string"
FILES = "directory string, filename string, content binary"


@dataclass
class Files(InputPartition):
    """Files that one task reads; of a large workbook a single sheet."""

    files: list[tuple[str, str | None]]


def visible(name: str) -> bool:
    return not name.startswith((".", "~$", "_"))


def listed(path: str, kind: str) -> list[store.Found]:
    found = [f for f in store.files(path) if visible(f.name) and KINDS.get(f.name.rpartition(".")[2].lower()) == kind]
    return [f for f in found if not any(p.startswith(("_", ".")) for p in f.uri[len(path.rstrip("/")) :].split("/"))]


def dealt(sized: list[tuple[tuple, int]], most: int) -> list[list[tuple]]:
    """Runs of neighbours of at most so many bytes together, or single larger ones."""
    out, size = [], most
    for item, own in sized:
        if size + own > most:
            out.append([])
            size = 0
        out[-1].append(item)
        size += own
    return out


# Workbooks


def header(names: list[tuple[str, str]]) -> list[str]:
    """Column names of a header: a blank one is _c and its place, a repeated one gets a number."""
    out: list[str] = []
    for k, (_, text) in enumerate(names):
        own = " ".join(text.split()) or f"_c{k}"
        n, name = 1, own
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{own}_{n}"
        out.append(name)
    return out


def common(kinds: set[tuple[str, bool]]) -> T.DataType:
    """The type of a column whose cells are of these kinds; numbers are marked whole or not."""
    found = {k for k, _ in kinds}
    if found == {"n"}:
        return T.LongType() if all(whole for _, whole in kinds) else T.DoubleType()
    if found == {"b"}:
        return T.BooleanType()
    if found == {"d"}:
        return T.DateType()
    return T.TimestampNTZType() if found in ({"t"}, {"d", "t"}) else T.StringType()


def value(text: str, kind: T.DataType):
    """A cell's text as a value, or None if it is empty or isn't one."""
    if text == "":
        return None
    try:
        if isinstance(kind, T.IntegralType):
            return int(text) if re.fullmatch(r"-?\d+", text) else int(Decimal(text))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text)
        if isinstance(kind, T.DecimalType):
            return Decimal(text).quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(text[:10])
        if isinstance(kind, T.BooleanType):
            return {"TRUE": True, "FALSE": False}.get(text.upper())
        if isinstance(kind, T.TimestampNTZType):
            return datetime.fromisoformat(text)
        if isinstance(kind, T.TimestampType):
            return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    except (ValueError, InvalidOperation):
        return None
    return text


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        if self.options.get("mode") == "cells":
            return CELLS
        return WorkbookReader(None, self.options).inferred()

    def reader(self, schema):
        return WorkbookReader(schema, self.options)

    def writer(self, schema, overwrite: bool):
        if [f.name for f in schema.fields] != ["sheet", "header", "cells"]:
            raise ValueError(f"a workbook is written from rows of ({SHEET_ROWS})")
        return WorkbookWriter(self.options, overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType | None, options):
        self.schema, self.path = schema, options["path"]
        self.cells = options.get("mode") == "cells"
        self.sheet, self.at = options.get("sheet"), options.get("headerRow", "1")
        self.fill, self.skip = options.get("merged", "first") == "fill", options.get("onError", "fail") == "skip"
        self.most, self.infer = int(options.get("partitionBytes", 16 << 20)), int(options.get("inferRows", 1000))

    def partitions(self):
        sized = []
        for f in listed(self.path, "excel"):
            sheets: list[str | None] = [None]
            if self.cells and self.sheet is None and f.size > self.most:  # the sheets of a large file go to several tasks
                try:
                    with store.read(f.uri) as file:
                        sheets = list(Workbook(file).sheets) or sheets
                except DamagedFile:  # the task that reads it says so
                    pass
            sized += [((f.uri, s), f.size // len(sheets)) for s in sheets]
        return [Files(some) for some in dealt(sized, self.most)] or [Files([])]

    def wanted(self, book: Workbook) -> str | None:
        names = list(book.sheets)
        return sheet_named(names, self.sheet) if self.sheet else next(iter(names), None)

    def begun(self, book: Workbook) -> tuple[list[str], Iterator] | None:
        """The names of the columns, and the rows that follow; None if there is no such sheet, or no header."""
        if (sheet := self.wanted(book)) is None:
            return None
        rows = book.rows(sheet, self.fill)
        first = []
        for number, cells in rows:
            first.append((number, cells))
            if number >= (10 if self.at == "auto" else int(self.at)):
                break
        if self.at == "auto":
            at = header_row([[text for _, text in cells] for _, cells in first])
        else:
            at = next((k for k, (number, _) in enumerate(first) if number == int(self.at)), None)
        if at is None:
            return None

        def rest():
            yield from first[at + 1 :]
            yield from rows

        return header(first[at][1]), rest()

    def inferred(self) -> T.StructType:
        """The columns of the first files, until `inferRows` rows have been seen; a column of blanks is one of texts."""
        kinds: dict[str, set[tuple[str, bool]]] = {}
        left = self.infer
        for f in listed(self.path, "excel"):
            try:
                with store.read(f.uri) as file:
                    names, rows = self.begun(Workbook(file)) or ([], iter(()))
                    own = [kinds.setdefault(n, set()) for n in names]
                    for _, cells in islice(rows, left):
                        left -= 1
                        for found, (kind, text) in zip(own, cells, strict=False):
                            if text != "":
                                found.add((kind, kind == "n" and re.fullmatch(r"-?\d{1,18}", text) is not None))
            except DamagedFile as e:
                if not self.skip:
                    raise ValueError(f"{f.uri}: {e}") from e
            if left <= 0:
                break
        if not kinds:
            raise ValueError(f"no sheet with a header in {self.path}")
        return T.StructType([T.StructField(n, common(k)) for n, k in kinds.items()])

    def read(self, partition):
        for uri, sheet in partition.files:
            try:
                with store.read(uri) as file:
                    yield from self.sheet_cells(uri, Workbook(file), sheet) if self.cells else self.table(Workbook(file))
            except DamagedFile as e:
                if not self.skip:
                    raise ValueError(f"{uri}: {e}") from e

    def sheet_cells(self, uri: str, book: Workbook, sheet: str | None):
        own = [sheet] if sheet else [self.wanted(book)] if self.sheet else list(book.sheets)
        for name in own:
            for number, cells in book.rows(name, self.fill) if name is not None else ():
                yield uri, name, list(book.sheets).index(name), number, [text for _, text in cells]

    def table(self, book: Workbook):
        if (found := self.begun(book)) is None:
            return
        names, rows = found
        place = {n: k for k, n in reversed(list(enumerate(names)))}
        at = [(place.get(f.name), f.dataType) for f in self.schema.fields]
        for _, cells in rows:
            if any(text for _, text in cells):  # rows of blanks are none
                yield tuple(value(cells[k][1], kind) if k is not None and k < len(cells) else None for k, kind in at)


# What sinks share: files written aside by the tasks, and published together


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where it is, where it belongs)

    def pairs(self) -> Iterator[tuple[str, str]]:
        return iter(self.files)


@dataclass
class Noted(WriterCommitMessage):
    """As Written, but in a file beside the task's files, so that the driver needn't hold them: a line for each, which is a JSON list."""

    note: str

    def pairs(self) -> Iterator[tuple[str, str]]:
        with store.read(self.note) as f, io.TextIOWrapper(io.BufferedReader(f), "utf-8") as lines:
            yield from map(json.loads, lines)


def named(target: str) -> int:
    return int.from_bytes(hashlib.blake2b(target.encode(), digest_size=8).digest(), "little")


class Staged(DataSourceWriter):
    """Tasks write into a folder of the job's own, which readers don't see; commit moves what successful tasks have written, abort
    deletes it.  What an attempt that failed has left goes with the folder.  The driver makes the folder and tasks don't, so a task
    that outlives its job can't bring it back."""

    def __init__(self, options):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.aside = f"{self.path}/_staging-{self.job}"
        store.make(self.aside)

    def own(self) -> str:
        """A folder of the task attempt's own; its files have no folders below it."""
        from pyspark import TaskContext

        task = TaskContext.get()
        own = f"{self.aside}/{task.partitionId()}-{task.taskAttemptId()}"
        store.make(own, above=False)
        return own

    def publish(self, messages: list[Written | Noted]) -> None:
        """Moves all, or, if a target is there already or a move fails, none.  The files are passed some at once, so of each the driver
        holds eight bytes, by which it finds names that occur twice."""
        names = array("Q")

        def checked(some) -> int:
            if found := store.there([t for _, t in some]):
                raise FileExistsError(found[0])
            return len(some)

        def moved(some) -> tuple[int, Exception | None]:
            for n, (source, target) in enumerate(some):
                try:
                    store.move(source, target)
                except Exception as e:  # noqa: BLE001
                    return n, e
            return len(some), None

        def back(some) -> None:
            for source, target in reversed(some):
                store.move(target, source)

        here = store.opened(self.path)[0].type_name == "local"
        with ThreadPoolExecutor(LOCAL_MOVERS if here else MOVERS) as many:  # a move waits for the store, so many wait together
            for some in self.taken(messages):
                names.extend(named(t) for _, t in some[0])
                list(many.map(checked, some[1]))
            self.unique(messages, names)
            done: list[int] = []  # files that have been moved of each part
            for _, parts in self.taken(messages):
                results = list(many.map(moved, parts))
                done += [n for n, _ in results]
                if failed := next((e for _, e in results if e), None):
                    parts = (part for _, own in self.taken(messages) for part in own)
                    for n, part in zip(done, parts, strict=False):
                        back(part[:n])
                    raise failed

    @staticmethod
    def taken(messages: list[Written | Noted]) -> Iterator[tuple[list, list[list]]]:
        """The files some at once, and the same in a part for each thread."""
        every = (tuple(p) for m in messages for p in m.pairs())
        while some := list(islice(every, MOVERS * TAKEN)):
            yield some, [some[k : k + TAKEN] for k in range(0, len(some), TAKEN)]

    @staticmethod
    def unique(messages: list[Written | Noted], names: array) -> None:
        own = np.sort(np.frombuffer(names, np.uint64))
        twice = set(own[1:][own[1:] == own[:-1]].tolist())
        if twice:  # few, unless names do occur twice
            seen: set[str] = set()
            for target in (t for m in messages for _, t in m.pairs() if named(t) in twice):
                if target in seen:
                    raise FileExistsError(f"a name occurs twice: {target}")
                seen.add(target)

    def commit(self, messages) -> None:
        self.publish([m for m in messages if m is not None])
        store.delete(self.aside)

    def abort(self, messages) -> None:
        store.delete(self.aside)


class WorkbookWriter(Staged):
    def __init__(self, options, overwrite: bool):
        super().__init__(options)
        self.overwrite, self.most = overwrite, int(options.get("rowsPerFile", 200_000))
        self.whole = str(options.get("wholeSheets", "false")).lower() == "true"

    def write(self, rows):
        own, out = self.own(), []
        writer = file = None
        sheet, n = None, 0

        def closed():
            writer.close()
            file.close()

        for row in rows:
            if writer is None or (n >= self.most and not (self.whole and row.sheet == sheet)):
                if writer is not None:
                    closed()
                name = f"part-{own.rpartition('/')[2].partition('-')[0].zfill(5)}-{len(out):04d}-{self.job}.xlsx"
                file = store.write(f"{own}/{name}", folders=False)
                writer, sheet, n = SheetWriter(file), None, 0
                out.append((f"{own}/{name}", f"{self.path}/{name}"))
            if row.sheet != sheet:
                sheet = row.sheet
                writer.sheet(sheet or "")
                writer.add([("s", h) for h in row.header])
            writer.add([(c.t, c.v) if c is not None else (None, None) for c in row.cells])
            n += 1
        if writer is not None:
            closed()
        return Written(out)

    def commit(self, messages) -> None:
        old = [f.uri for f in listed(self.path, "excel")] if self.overwrite else []
        super().commit(messages)
        for uri in old:
            store.delete(uri)


# Word files


class WordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self):
        return WORDS

    def reader(self, schema):
        return WordReader(self.options)


class WordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("partitionBytes", 16 << 20))

    def partitions(self):
        return [Files(some) for some in dealt([((f.uri, None), f.size) for f in listed(self.path, "word")], self.most)] or [Files([])]

    def read(self, partition):
        for uri, _ in partition.files:
            try:
                with store.read(uri) as file:
                    lines, tables, sections = word_lines(file)
                yield uri, "\n".join(lines), lines, tables, sections, None
            except DamagedFile as e:
                yield uri, None, None, None, None, str(e)


# Watched folders


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self):
        return VERSIONS

    def streamReader(self, schema):
        return FolderStream(self.options)


class FolderStream(DataSourceStreamReader):
    """A folder's files of known kinds, each version once.  Each look at the folder is a numbered entry in the folder `state`: the
    versions (path, size, time) that came and the paths that went since the entry before.  An offset is an entry's number,
    so what a look has found belongs to a batch for good, and a file that comes while a batch runs is found by the next look.
    A file that goes and comes back counts again.  The driver holds the folder's listing, as Spark's own file stream does; every tenth
    entry holds it whole, so that few are read again.  Options: path, state, recursive, content (false: without), partitionBytes."""

    WHOLE = 10

    def __init__(self, options):
        self.path, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.recursive, self.content = options.get("recursive", "false") == "true", options.get("content", "true") == "true"
        self.most = int(options.get("partitionBytes", 32 << 20))

    def entry(self, n: int) -> dict:
        with store.read(f"{self.state}/{n:09d}.json") as f:
            return json.loads(f.read())

    def last(self) -> int:
        return max((int(f.name[:9]) for f in store.files(self.state) if re.fullmatch(r"\d{9}\.json", f.name)), default=0)

    def known(self, n: int) -> dict[str, list[int]]:
        """The listing at entry n."""
        first = n - n % self.WHOLE
        there = self.entry(first).get("whole", {}) if first else {}
        for k in range(first + 1, n + 1):
            change = self.entry(k)
            there = {p: v for p, v in there.items() if p not in set(change["gone"])} | {p: [s, m] for p, s, m in change["came"]}
        return there

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        last = self.last()
        before = self.known(last)
        found = [f for f in store.files(self.path, self.recursive) if not f.name.startswith((".", "~$")) and f.name.rpartition(".")[2].lower() in KINDS]
        now = {f.uri: [f.size, f.modified] for f in found}
        came = [[p, *v] for p, v in now.items() if before.get(p) != v]
        gone = [p for p in before if p not in now]
        if came or gone:
            last += 1
            body = {"came": came, "gone": gone} | ({"whole": now} if last % self.WHOLE == 0 else {})
            aside = f"{self.state}/.{uuid.uuid4().hex}"
            with store.write(aside) as f:
                f.write(json.dumps(body).encode())
            store.move(aside, f"{self.state}/{last:09d}.json")
        return {"entry": last}

    def partitions(self, start: dict, end: dict):
        sized = [((p, s, m, n), s) for n in range(start["entry"] + 1, end["entry"] + 1) for p, s, m in self.entry(n)["came"]]
        return [Files(some) for some in dealt(sized, self.most)]

    def read(self, partition):
        for uri, size, modified, version in partition.files:
            name, data, error = uri.rpartition("/")[2], None, None
            if self.content:
                try:
                    with store.read(uri) as f:
                        data = f.read()
                    if len(data) != size:
                        data, error = None, "the file has changed"  # its new version comes by itself
                except FileNotFoundError:
                    error = "the file is gone"
            yield uri, name, KINDS[name.rpartition(".")[2].lower()], size, datetime.fromtimestamp(modified, timezone.utc), version, data, error

    def commit(self, end: dict) -> None:
        pass  # entries stay: they are the listing that the next look is compared with


# Archives


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self):
        return FILES

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("an archive is only added to")
        if [f.name for f in schema.fields] != ["directory", "filename", "content"]:
            raise ValueError(f"an archive is written from rows of ({FILES})")
        return ArchiveWriter(self.options)


class ArchiveWriter(Staged):
    """SNK-01, SNK-12: names must be new; sinks.archived makes them so.  A name that is taken meanwhile fails the job, and then
    nothing is published.  The driver moves the files, some at once, as tasks have noted them; this is for files that people read, tables are for the rest."""

    def write(self, rows):
        own = self.own()
        with store.write(f"{own}/files", folders=False) as note:
            for n, row in enumerate(rows):
                place = f"{row.directory.strip('/')}/{row.filename}" if row.directory else row.filename
                if not row.filename or any(p in ("", ".", "..") for p in place.split("/")):
                    raise ValueError(f"not a place in the archive: {place!r}")
                with store.write(f"{own}/{n}", folders=False) as f:
                    f.write(row.content or b"")
                note.write(json.dumps([f"{own}/{n}", f"{self.path}/{place}"]).encode() + b"\n")
        return Noted(f"{own}/files")


def register(spark: SparkSession) -> None:
    for source in (WorkbookSource, WordSource, FolderSource, ArchiveSource):
        spark.dataSource.register(source)
