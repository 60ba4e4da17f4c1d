"""Files for people: reports as workbooks, and archives with unique names (SNK-01, SNK-03, SNK-12, SRC-06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers, store
from ..sources.files import listing
from ..sources.readers import SHEET_ROWS
from .lifecycle import unique_names


def cell(c: Column, kind: T.DataType) -> Column:
    """A value as a workbook's cell: its kind and text."""
    if isinstance(kind, T.NumericType):
        t, v = "n", c.cast("string")
        if isinstance(kind, (T.DoubleType, T.FloatType)):  # what isn't a number can't be a number's cell
            odd = F.isnan(c) | F.abs(c).isin(float("inf"))
            return F.struct(F.when(c.isNotNull(), F.when(odd, "s").otherwise("n")).alias("t"), v.alias("v"))
    elif isinstance(kind, T.BooleanType):
        t, v = "b", c.cast("int").cast("string")
    elif isinstance(kind, T.DateType):
        t, v = "d", F.datediff(c, F.lit("1899-12-30").cast("date")).cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date"))
        t, v = "t", (whole + (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) / 86400).cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        t, v = "s", F.to_json(c)
    else:
        t, v = "s", c.cast("string")
    return F.struct(F.when(c.isNotNull(), F.lit(t)).alias("t"), v.alias("v"))


def workbook_rows(table: DataFrame, sheet: str | Column) -> DataFrame:
    """The rows that the format `workbook` takes."""
    names = F.array(*[F.lit(c) for c in table.columns])
    cells = F.array(*[cell(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields])
    return table.select((F.lit(sheet) if isinstance(sheet, str) else sheet).alias("sheet"), names.alias("header"), cells.alias("cells"))


def write_workbooks(tables: dict[str, DataFrame], folder: str, files: int | None = None, mode: str = "append", rows_per_file: int = 200_000) -> None:
    """SNK-03: the tables as sheets of workbooks.  Each file has the sheets of the rows that its task holds, in the order of `tables`;
    with files=1 a report is one workbook, as long as its rows are fewer than rows_per_file."""
    spark = next(iter(tables.values())).sparkSession
    readers.register(spark)
    numbered = [workbook_rows(t, n).withColumn("_k", F.lit(k)) for k, (n, t) in enumerate(tables.items())]
    rows = reduce(DataFrame.union, numbered)
    rows = (rows.repartition(files) if files else rows).sortWithinPartitions("_k").drop("_k")
    rows.to(T._parse_datatype_string(SHEET_ROWS)).write.format("workbook").mode(mode).option("rowsPerFile", rows_per_file).save(folder)


def cells_of(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """SRC-10, SRC-12: path, sheet, place, row, cells of all workbooks below a folder."""
    readers.register(spark)
    return spark.read.format("workbook").options(mode="cells", **options).load(folder)


def workbook_texts(cells: DataFrame, most: int = 500) -> DataFrame:
    """SRC-06: the text of each workbook, sheet by sheet, and its tables: rows that aren't blank, of each sheet's first 500, and a line
    that says so if there are more."""
    inside = cells.filter(F.exists("cells", lambda c: F.trim(c) != "")).withColumn("cells", F.transform("cells", lambda c: F.trim(c)))
    sheets = cells.groupBy("path", "place", "sheet").agg(F.max("row").alias("_last"))
    rows = inside.filter(F.col("row") <= most).groupBy("path", "place").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("_rows"))
    rows = sheets.join(rows, ["path", "place"], "left").withColumn("table", F.coalesce(F.transform("_rows", lambda r: r["cells"]), F.array().cast("array<array<string>>")))
    lines = F.concat(
        F.array(F.concat(F.lit("Sheet: "), "sheet")),
        F.transform("table", lambda r: F.array_join(r, " | ")),
        F.when(F.col("_last") > most, F.array(F.lit(f"…（已截断，该表超过 {most} 行）"))).otherwise(F.array().cast("array<string>")),
    )
    parts = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "sheet", F.array_join(lines, "\n").alias("text"), "table"))).alias("_s"))
    return parts.select("path", F.array_join(F.transform("_s", lambda s: s["text"]), "\n\n").alias("text"), F.transform("_s", lambda s: s["sheet"]).alias("sheets"), F.transform("_s", lambda s: s["table"]).alias("tables"))


def archived(docs: DataFrame, folder: str, directory: Column, name: Column, content: Column, key: str = "id") -> DataFrame:
    """SNK-01, SNK-12: writes each document as a file of the archive, under a name that is new in its directory, and returns key, directory
    and filename.  Names that the archive has count as taken: the next number is used."""
    spark = docs.sparkSession
    readers.register(spark)
    names = unique_names(docs, directory, name, key, taken=existing(spark, folder))
    rows = docs.select(key, content.cast("binary").alias("content")).join(names, key)
    rows.select("directory", "filename", "content").write.format("archive").mode("append").save(folder)
    return names


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """directory and filename of an archive's files."""
    base = folder.rstrip("/")
    if not store.exists(base):
        return spark.createDataFrame([], "directory string, filename string")
    place = F.substring("path", len(base) + 2, 1 << 30)
    return listing(spark, base).select(F.regexp_extract(place, r"^(?s)(.*)/[^/]*$", 1).alias("directory"), F.element_at(F.split(place, "/"), -1).alias("filename"))
