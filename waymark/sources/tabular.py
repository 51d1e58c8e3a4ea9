"""Tabular readers (inventory 2.A): CSV and spreadsheets, each row a map of header to text with its file, sheet and row number."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_value

ROW = "source_file string, source_sheet string, row_number long, fields map<string,string>"


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A-1: all columns as text, null-like texts as null, rows without any value dropped after they have been numbered.

    Of headers that are one without white space around them the last one's value counts. With ``multi_line``, quoted
    fields may hold line breaks; then a file is one task's, which suits uploads (``upload_problems`` limits their size).
    Without, a file is read in splits by many tasks, and its fields must be free of line breaks. A row's number (2 for the first below the header) is its place in its split
    and the rows of the file's earlier splits, of which there are as many numbers as splits.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", escape='"', multiLine=multi_line)
    columns = {c.strip(): c for c in raw.columns}
    rows = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    splits = rows.groupBy("__file", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    numbered = rows.join(splits, ["__file", "__at"]).withColumn("row_number", F.col("__id") - F.col("__first") + F.col("__before") + 2)
    values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[clean_value(F.col(f"`{c}`")) for c in columns.values()]))
    out = numbered.select(F.regexp_replace("__file", "^.*/", "").alias("source_file"), F.lit(None).cast("string").alias("source_sheet"), "row_number", values.alias("fields"))
    return out.filter(F.exists(F.map_values("fields"), lambda v: v.isNotNull()))


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str | None]]:
    """A sheet's rows as texts; whole numbers without a fraction."""
    for _, row in ElementTree.iterparse(book.open(part)):
        if not row.tag.endswith("}row"):
            continue
        cells: dict[int, str] = {}
        for c in row:
            column = 0
            for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                column = column * 26 + ord(letter) - 64
            value = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
            if c.get("t") == "s" and value:
                value = shared[int(value)]
            cells[column or len(cells) + 1] = value
        yield [cells.get(i) for i in range(1, max(cells, default=0) + 1)]
        row.clear()


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A-2: every sheet of XLSX files. A workbook is one compressed file, so it is one task's; many files are many tasks'."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = set(book.namelist())
                    strings = ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
                    shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in strings]
                    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
                        if not s.tag.endswith("}sheet"):
                            continue
                        target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
                        header, rows = None, []
                        for n, row in enumerate(_sheet_rows(book, f"xl/{target}" if not target.startswith("/") else target[1:], shared), 1):
                            if header is None:
                                header = [(h or "").strip() for h in row]
                                continue
                            rows.append((name.rsplit("/", 1)[-1], s.get("name"), n, {h: v for h, v in zip(header, row) if h}))
                        yield pd.DataFrame(rows, columns=["source_file", "source_sheet", "row_number", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, ROW)
    return rows.withColumn("fields", F.transform_values("fields", lambda _, v: clean_value(v))).filter(F.exists(F.map_values("fields"), lambda v: v.isNotNull()))


def upload_problems(files: DataFrame, limit_bytes: int = 100 << 20) -> DataFrame:
    """A-17, T-6, T-7: why a file (``path``, ``length``, ``content``) isn't taken; null where it is."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    zipped = suffix.isin("xlsx", "kmz", "zip")
    return files.select(
        "path",
        F.when(~suffix.isin("csv", "xls", "xlsx", "kml", "kmz", "zip"), "unsupported extension")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > limit_bytes, "file too large")
        .when(zipped & (head != "504B0304"), "content does not match extension")
        .when((suffix == "xls") & (head != "D0CF11E0"), "content does not match extension")
        .alias("problem"),
    )
