"""Workbooks by the standard library: an .xlsx file is a zip of XML. Executors read the files, of any file system that Spark knows, and parse them row by row."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import ship

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = dt.datetime(1899, 12, 30)
#: Built-in number formats that show dates (ECMA-376, 18.8.30).
_DATES = {*range(14, 23), *range(45, 48)}


def serial_date(serial: float) -> str:
    """ISO text of a workbook's day number; midnight gives the date alone."""
    when = _EPOCH + dt.timedelta(seconds=round(serial * 86400))
    return when.date().isoformat() if when.time() == dt.time() else when.isoformat()


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cells(z: zipfile.ZipFile, path: str, strings: list[str], dated: list[bool]) -> Iterator[list[Any]]:
    """A sheet's rows one after another; the XML is never held whole."""
    with z.open(path) as xml:
        for _, row in ElementTree.iterparse(xml):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            out: list[Any] = []
            for c in row.iterfind("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(out)
                out += [None] * (at + 1 - len(out))
                v, kind = c.find("m:v", _NS), c.get("t", "n")
                if kind == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
                elif v is not None and v.text is not None:
                    if kind == "s":
                        out[at] = strings[int(v.text)]
                    elif kind == "b":
                        out[at] = "true" if v.text == "1" else "false"
                    elif kind == "n":
                        x = float(v.text)
                        out[at] = serial_date(x) if dated[int(c.get("s", 0))] else str(int(x)) if x.is_integer() else repr(x)
                    else:
                        out[at] = v.text
            row.clear()
            yield out


def sheets(source: str | BinaryIO) -> Iterator[tuple[str, Iterator[list[Any]]]]:
    """(name, rows) of every sheet in order, of a path or a file. A sheet's rows must be taken before the next sheet."""
    with zipfile.ZipFile(source) as z:
        names = set(z.namelist())
        shared = ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else ()
        strings = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in shared]
        dated = [False] * 1000
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iterfind(".//m:numFmt", _NS) if re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            dated = [int(x.get("numFmtId", 0)) in _DATES | own for x in styles.iterfind("m:cellXfs/m:xf", _NS)] or dated
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            yield s.get("name"), _cells(z, target if target.startswith("xl/") else f"xl/{target}", strings, dated)


def to_rows(values: Iterable[list[Any]]) -> Iterator[tuple[list[str], list[Any]]]:
    """(header, row) of each row of data: the first row that isn't blank names the columns, blank names get a number, blank rows go."""
    header: list[str] = []
    for r in values:
        if any(v not in (None, "") for v in r):
            if header:
                yield header, (r + [None] * len(header))[: len(header)]
            else:
                header = [str(v).strip() if v not in (None, "") else f"column_{i + 1}" for i, v in enumerate(r)]


_CELLS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("nth_sheet", pa.int32()), ("nth_row", pa.int64()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CELLS, strict=True)], schema=_CELLS)
        rows.clear()
        return got

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                for k, (name, values) in enumerate(sheets(pa.BufferReader(content.as_buffer()))):
                    for n, (header, row) in enumerate(to_rows(values)):
                        rows.append((path, name, k, n, header, row, None))
                        if len(rows) >= 2000:
                            yield out()
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
                rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
    if rows:
        yield out()


def read_workbooks(files: DataFrame) -> DataFrame:
    """Rows of all sheets of binary files (path, content): path, sheet, nth_sheet, nth_row, header, cells (texts), error.

    Executors parse the files that they read, one row of a sheet at a time; a file that is no workbook gives one row with an error, an empty file none.
    """
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_read, "path string, sheet string, nth_sheet int, nth_row long, header array<string>, cells array<string>, error string")


def binaries(spark: SparkSession, path: str, suffix: str = "xlsx") -> DataFrame:
    """Files below a path of any file system that Spark reads: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)


def as_table(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    """cells under the names of a header; equal names get _2, _3 and so on."""
    names, seen = [], Counter()
    for h in header:
        seen[h] += 1
        names.append(h.replace("`", "") if seen[h] == 1 else f"{h}_{seen[h]}".replace("`", ""))
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_sheets(spark: SparkSession, path: str) -> Iterator[tuple[str, DataFrame]]:
    """(sheet, frame of texts) of every sheet with rows, in order. The driver gets one row a sheet; a broken file is an error."""
    rows = read_workbooks(binaries(spark, path))
    found = rows.groupBy("nth_sheet", "sheet", "error").agg(F.first("header").alias("header")).orderBy("nth_sheet").collect()
    for r in found:
        if r["error"]:
            raise zipfile.BadZipFile(f"{path}: {r['error']}")
        yield r["sheet"], as_table(rows.where(F.col("nth_sheet") == r["nth_sheet"]).orderBy("nth_row"), r["header"])


def workbook(tables: dict[str, list[list[Any]]]) -> bytes:
    """A workbook of sheets of rows: texts, numbers and empty cells, without styles."""
    main, rel = _NS["m"], "http://schemas.openxmlformats.org/package/2006/relationships"
    office = _REL[1:].partition("}")[0]

    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)  # equal tables give equal bytes

        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(tables)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(tables))) + "</Relationships>")
        for i, rows in enumerate(tables.values()):
            put(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()
