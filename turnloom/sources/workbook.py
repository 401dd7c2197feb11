"""Workbooks (xlsx) as rows of cells, read from their zipped XML without a library.

Files are listed by Spark and parsed where they are read, one file to a row of the
``binaryFile`` source; a sheet is read as it streams. Only what a table holds is
taken: shared and inline text, numbers, booleans; formulas give their stored value.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError, require

# XML names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """Place of a cell in its row, from 0: 'A7' is 0, 'AA7' is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in root.iter(f"{MAIN}si")]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), f"xl/{links[s.get(LINK)].removeprefix('/xl/')}") for s in book.iter(f"{MAIN}sheet")]


def _value(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    return v.text


def sheet_rows(blob: bytes):
    """(sheet, row number, cells) of every row with a value, in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            shared = _texts(z)
            for name, member in _sheets(z):
                with z.open(member) as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag != f"{MAIN}row":
                            continue
                        cells: list[str | None] = []
                        for c in e.iter(f"{MAIN}c"):
                            at = column_number(c.get("r"))
                            cells.extend([None] * (at + 1 - len(cells)))
                            cells[at] = _value(c, shared)
                        if any(x is not None for x in cells):
                            yield name, int(e.get("r")), cells
                        e.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as x:
        raise ContractError("INVALID_WORKBOOK") from x


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row (its number), cells (array of text) of all workbooks below
    ``path``; temporary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")

    def run(batches):
        for b in batches:
            for where, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = []
                for sheet, n, cells in sheet_rows(blob):
                    held.append((where, sheet, n, cells))
                    if len(held) == 5000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return files.mapInArrow(run, "path string, sheet string, row long, cells array<string>")


def _batch(rows):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "sheet", "row", "cells"])


def header_name(c: Column) -> Column:
    """A heading without white space around it, line ends inside it as spaces."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def table(rows: DataFrame, names: dict[str, list[str]], sheet: str | None = None) -> DataFrame:
    """Rows below each sheet's first row as columns. ``names``: for each column the
    headings that it may have; a column without a heading is an error, a repeated
    heading too."""
    own = rows if sheet is None else rows.where(F.col("sheet") == sheet)
    first = own.groupBy("path", "sheet").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("first"))
    first = first.withColumn("head", F.transform("head", lambda x: header_name(F.coalesce(x, F.lit("")))))
    for r in first.select("path", "sheet", "head").toLocalIterator():  # a row for each sheet
        named = [h for h in r.head if h]
        require(len(set(named)) == len(named), "REPEATED_HEADING", f"{r.path} {r.sheet}")
        for column, known in names.items():
            require(any(h in known for h in named), "COLUMN_MISSING", f"{column}: {r.path} {r.sheet}")
    both = own.join(F.broadcast(first), ["path", "sheet"]).where(F.col("row") > F.col("first"))
    value = lambda known: F.coalesce(*[F.try_element_at("cells", F.nullif(F.array_position("head", h), F.lit(0)).cast("int")) for h in known])
    return both.select("path", "sheet", F.col("row").alias("_row"), *[value(known).alias(c) for c, known in names.items()])
