"""A corpus of workbooks as tables: discovery by content, loads that take each file once, reconciliation of what was planned and what is there.

Files are known by the SHA-256 of their bytes, so copies and renamed files are one. A load reads the files that the manifest doesn't name,
writes their sheets below a folder of their hash, replacing whatever a load that died has left there, and adds their rows to the manifest
last. So a load may be killed and run again: nothing is there twice, and nothing counts that isn't whole. One load at a time.

    target/tables/sha256=.../nth_sheet=.../    nth_row, cells
    target/manifest/                           sha256, path, n_bytes, nth_sheet, sheet, table_name, header, planned
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import table_token
from ..sources import xlsx
from ..workspace import listed, qualified

MANIFEST = "sha256 string, path string, n_bytes long, nth_sheet int, sheet string, table_name string, header array<string>, planned long"
_TABLE = "nth_row long, cells array<string>, sha256 string, nth_sheet int"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return xlsx.binaries(spark, folder).withColumn("sha256", F.sha2("content", 256))


def discover(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (path, content, length, sha256): a manifest of every sheet with rows, and (path, error) of files that are no workbooks.

    A table is named by its file, its sheet and the first digits of the hash: the name stays whatever else is loaded, and files of one name don't collide.
    """
    one = files.groupBy("sha256").agg(F.min("path").alias("path"), F.first("length").alias("n_bytes"))
    first = files.join(one.select("sha256", F.col("path").alias("_p")), "sha256").where(F.col("path") == F.col("_p"))
    rows = xlsx.read_workbooks(first)
    errors = rows.where("error IS NOT NULL").select("path", "error")
    each = rows.where("error IS NULL").groupBy("path", "nth_sheet", "sheet").agg(F.first("header").alias("header"), F.count("*").alias("planned"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = each.join(one, "path").withColumn("table_name", F.concat_ws("_", table_token(stem), table_token(F.col("sheet")), F.substring("sha256", 1, 8)))
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy("nth_sheet"))  # sheets of one file whose names become equal
    named = named.withColumn("_n", nth).withColumn("table_name", F.when(F.col("_n") == 1, F.col("table_name")).otherwise(F.concat_ws("_", "table_name", "_n")))
    return named.select("sha256", "path", "n_bytes", "nth_sheet", "sheet", "table_name", "header", "planned"), errors


def manifest(spark: SparkSession, target: str) -> DataFrame:
    where = f"{qualified(spark, target)}/manifest"
    return spark.read.schema(MANIFEST).parquet(where) if listed(spark, where) else spark.createDataFrame([], MANIFEST)


def load(spark: SparkSession, folder: str, target: str) -> int:
    """Loads the files that aren't in the manifest; returns how many sheets were added. Files that are no workbooks are left out, see discover()."""
    target = qualified(spark, target)
    known = manifest(spark, target).select("sha256").distinct()
    files = _files(spark, folder).join(known, "sha256", "left_anti")
    found, _ = discover(files)
    found = found.persist()  # small: one row a sheet; lost parts are parsed again
    n = found.count()
    if n:
        first = files.join(found.select("sha256", F.col("path").alias("_p")).distinct(), "sha256").where(F.col("path") == F.col("_p"))
        rows = xlsx.read_workbooks(first.select("path", "content")).where("error IS NULL")
        rows = rows.join(found.select("path", "nth_sheet", "sha256"), ["path", "nth_sheet"]).select("nth_row", "cells", "sha256", "nth_sheet")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha256", "nth_sheet").parquet(f"{target}/tables")
        found.coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    found.unpersist()
    return n


def tables(spark: SparkSession, target: str) -> DataFrame:
    """All loaded rows: table_name, nth_row, cells. Only what the manifest names counts."""
    where = f"{qualified(spark, target)}/tables"
    stored = spark.read.schema(_TABLE).parquet(where) if listed(spark, where) else spark.createDataFrame([], _TABLE)
    return stored.join(manifest(spark, target).select("sha256", "nth_sheet", "table_name"), ["sha256", "nth_sheet"]).select("table_name", "nth_row", "cells")


def table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One loaded sheet under its header, all texts; partitions of other sheets aren't read."""
    row = manifest(spark, target).where(F.col("table_name") == name).head()
    if row is None:
        raise KeyError(name)
    stored = spark.read.schema(_TABLE).parquet(f"{qualified(spark, target)}/tables")
    return xlsx.as_table(stored.where((F.col("sha256") == row["sha256"]) & (F.col("nth_sheet") == row["nth_sheet"])).orderBy("nth_row"), row["header"])


def reconciled(spark: SparkSession, target: str) -> DataFrame:
    """(table_name, planned, loaded, equal): rows by the manifest and rows that are there, of either side's tables."""
    planned = manifest(spark, target).select("table_name", "planned")
    where = f"{qualified(spark, target)}/tables"
    stored = spark.read.schema(_TABLE).parquet(where) if listed(spark, where) else spark.createDataFrame([], _TABLE)
    counts = stored.groupBy("sha256", "nth_sheet").agg(F.count("*").alias("loaded"))
    names = manifest(spark, target).select("sha256", "nth_sheet", "table_name")
    counts = counts.join(names, ["sha256", "nth_sheet"], "left").select(F.coalesce("table_name", F.concat(F.lit("not in the manifest: "), F.col("sha256"))).alias("table_name"), "loaded")
    both = planned.join(counts, "table_name", "full").fillna(0, ["planned", "loaded"])
    return both.withColumn("equal", F.col("planned") == F.col("loaded"))
