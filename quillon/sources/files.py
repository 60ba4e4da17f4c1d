"""Files as rows (SRC-02, SRC-07, SRC-08, SRC-16, FN-70, FN-75, FN-81, FN-82): Spark's own readers, with providers where a format needs
a library that isn't here (PDF, office formats, pictures, recognition of text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .shared import written

#: Tasks for each core that read a folder of small files.
TASKS = 4


def tasks(spark: SparkSession) -> int:
    return TASKS * spark.sparkContext.defaultParallelism


def together(files: DataFrame) -> DataFrame:
    """Files are read one after the other by some tasks for each core: Spark counts each as 4 MB, so it would deal small ones out a few to
    a task."""
    return files.coalesce(tasks(files.sparkSession))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of all files below a folder, as a table.  Folders are listed by tasks, one level after the other, so a task holds what
    stands in one folder, and the driver no file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for uri in rows.column("path").to_pylist():
                found = store.children(uri)
                for k in range(0, len(found), 10_000):
                    paths, sizes = zip(*found[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    levels, folders = [], spark.createDataFrame([(folder,)], "path string")
    while not levels or not folders.isEmpty():
        levels.append(written(folders.repartition(tasks(spark), "path").mapInArrow(look, "path string, size long"), "listing"))
        folders = levels[-1].filter("size IS NULL").select("path")
    return reduce(DataFrame.union, levels).filter("size IS NOT NULL")


def contents(files: DataFrame, most: int = 16 << 20) -> DataFrame:
    """The files (path, size) with their content, dealt out to some tasks for each core; about 16 MB of it go together."""

    def batch(own: list[tuple]) -> pa.RecordBatch:
        paths, sizes, found = zip(*own, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["path", "size", "content"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own, held = [], 0
            for path, size in zip(*(rows.column(c).to_pylist() for c in ("path", "size")), strict=True):
                with store.read(path) as f:
                    own.append((path, size, f.read()))
                held += len(own[-1][2])
                if held >= most:
                    yield batch(own)
                    own, held = [], 0
            if own:
                yield batch(own)

    return files.select("path", "size").repartition(tasks(files.sparkSession), "path").mapInArrow(load, "path string, size long, content binary")


#: Kinds of files by extension.
KINDS = {
    "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tif": "image", "tiff": "image", "webp": "image",
    "docx": "word", "xlsx": "excel", "xlsm": "excel", "txt": "text", "md": "text", "csv": "csv", "doc": "old", "xls": "old",
}
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain", "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    """SRC-02: the kind of a file, or null if it isn't supported."""
    return F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[extension(path)]


def mime(path: Column) -> Column:
    """FN-75."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[extension(path)], F.lit("application/octet-stream"))


@F.pandas_udf(T.StringType())
def any_text(content: pd.Series) -> pd.Series:
    """SRC-07 with GB 18030, which Spark's decode doesn't offer: the first encoding that fits."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for encoding in ("utf-8", "gb18030", "utf-16"):
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                pass
        return data.decode("utf-8", errors="replace")

    return content.map(one)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-16, FN-70: supported files below a folder, hidden and lock files left out: path, name, kind, size, file_hash, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), kind(name).alias("kind"), F.col("length").alias("size"), "content")
    return rows.filter(~F.col("name").rlike(r"^(\.|~\$|_)") & F.col("kind").isNotNull()).withColumn("file_hash", F.sha2("content", 256))


def texts(files: DataFrame) -> DataFrame:
    """SRC-07: the text files' text."""
    return files.filter("kind = 'text'").select("path", "name", "file_hash", any_text("content").alias("text"))


def delimited(files: DataFrame) -> DataFrame:
    """SRC-08: the rows of delimited files as arrays of cells, without rows of blanks: the delimiter is the most frequent of , ; and tab in
    the first line.  Quoted cells may hold delimiters but no line breaks."""
    text = any_text("content")
    rows = files.filter("kind = 'csv'").select("path", F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n").alias("_lines"))
    count = lambda d: F.size(F.split(F.get("_lines", F.lit(0)), d))
    delimiter = F.when((count("\t") > count(",")) & (count("\t") > count(";")), "\t").when(count(";") > count(","), ";").otherwise(",")
    long = rows.select("path", delimiter.alias("_d"), F.posexplode("_lines").alias("line", "_text")).filter(F.trim("_text") != "")
    quoted = [F.split(F.col("_text"), d + r'(?=(?:[^"]*"[^"]*")*[^"]*$)') for d in (",", ";", "\t")]
    cells = F.when(F.col("_d") == ",", quoted[0]).when(F.col("_d") == ";", quoted[1]).otherwise(quoted[2])
    clean = F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))
    return long.select("path", "line", clean.alias("cells")).filter(F.exists("cells", lambda c: c != ""))


Parser = Callable[[bytes, str], str | None]


def parsed(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """SRC-03 to SRC-06, SRC-09, UDF-06, UDF-08: text of binary files by a provider for each kind; a parser is loaded once for each task, and
    its failure is a row's error.  Kinds without a provider have neither text nor error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                text = error = None
                try:
                    text = parsers[r.kind](r.content, r.name) if r.kind in parsers else None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append((r.path, r.file_hash, text, error))
            yield pd.DataFrame(out, columns=["path", "file_hash", "text", "error"])

    return files.select("path", "name", "kind", "file_hash", "content").mapInPandas(run, "path string, file_hash string, text string, error string")


def needs_recognition(text: Column, pages: Column, least: int = 50) -> Column:
    """SRC-03: fewer than 50 characters a page mean that a PDF's pages are pictures."""
    return F.char_length(F.coalesce(text, F.lit(""))) / F.greatest(pages, F.lit(1)) < least


def usable_text(text: Column, blocks: Column, words: list[str]) -> Column:
    """FLT-19: a structure word, or 30 characters and two blocks."""
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return hit | ((F.char_length(text) >= 30) & (blocks >= 2))


ANSWER = "document_type string, confidence double, company string, reason string"


def answer(text: Column) -> Column:
    """FN-81, FN-82, SRC-21: a model's answer as a struct: the first { to the last } of it, fences aside; null if the type is missing or the
    confidence isn't between 0 and 1."""
    body = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), ANSWER)
    return F.when((F.coalesce(body["document_type"], F.lit("")) != "") & body["confidence"].between(0, 1), body)


def is_attachment(name: Column, kinds: dict[str, str] = KINDS) -> Column:
    """FLT-22: files that mail may bring in."""
    return extension(name).isin(*[k for k, v in kinds.items() if v != "old"]) & (F.lower(name) != "winmail.dat")
