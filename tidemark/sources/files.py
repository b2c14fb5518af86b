"""File sources: CSV, JSON, JSON Lines and workbooks as DataFrames, with a report of what was skipped."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx


class UnsupportedFile(ValueError):
    """No reader for a file's suffix, or a file that isn't of the expected shape."""


class MissingReader(RuntimeError):
    """A format whose reader isn't installed."""


@dataclass(frozen=True)
class Dataset:
    path: str
    table: str
    kind: str
    frame: DataFrame
    sheet: str | None = None


def table_name(text: str) -> str:
    out = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in text.lower())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_") or "table"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns are texts; quoted line feeds are allowed."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object with exactly one list of objects."""
    df = spark.read.json(path, multiLine=True)
    if "_corrupt_record" in df.columns:
        raise UnsupportedFile(f"{path} is not JSON")
    shape = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).head()
    if shape and shape[0] == "{":
        lists = [f.name for f in df.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
        if len(lists) != 1:
            raise UnsupportedFile(f"{path} has {len(lists)} lists of objects; one is needed")
        return df.select(F.inline(F.col(f"`{lists[0]}`")))
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """An object a line; blank lines are skipped, other lines are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.where(~F.col("value").rlike(r"^\s*\{.*\}\s*$")).head()
    if bad:
        raise UnsupportedFile(f"{path}: a line is not an object")
    return spark.read.json(path, mode="FAILFAST")


def read_xls(spark: SparkSession, path: str) -> DataFrame:
    raise MissingReader("reading .xls needs xlrd, which is not a dependency; save the workbook as .xlsx")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl, ".xls": read_xls}


def load(spark: SparkSession, path: str) -> list[Dataset]:
    """The tables of a file: one, or one a sheet that has rows."""
    stem, suffix = os.path.splitext(os.path.basename(path))
    suffix = suffix.lower()
    if suffix == ".xlsx":
        sheets = list(xlsx.read_sheets(spark, path))
        names = deduped([table_name(f"{stem}_{s}" if len(sheets) > 1 else stem) for s, _ in sheets])
        return [Dataset(path, n, "xlsx", df, s) for n, (s, df) in zip(names, sheets, strict=True)]
    if suffix not in READERS:
        raise UnsupportedFile(f"no reader for {suffix or 'files without suffix'}: {path}")
    return [Dataset(path, table_name(stem), suffix[1:], READERS[suffix](spark, path))]


def deduped(names: list[str]) -> list[str]:
    """Later copies of a name get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def scan(spark: SparkSession, root: str) -> tuple[list[Dataset], list[tuple[str, str]]]:
    """All tables below a folder in the order of paths, and (path, reason) of files that were skipped."""
    found, skipped = [], []
    paths = sorted(os.path.join(d, f) for d, _, files in os.walk(root) for f in files)
    for p in paths:
        try:
            found += load(spark, p)
        except (UnsupportedFile, MissingReader) as e:
            skipped.append((p, str(e)))
    return found, skipped


def preview_session(spark: SparkSession, root: str) -> tuple[SparkSession, list[str], list[tuple[str, str]]]:
    """A session of its own with a view for each table below a folder."""
    own = spark.newSession()
    found, skipped = scan(own, root)
    for d in found:
        d.frame.createOrReplaceTempView(d.table)
    return own, [d.table for d in found], skipped
