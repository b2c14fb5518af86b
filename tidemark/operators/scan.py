"""Scan of a database: allowed tables, their columns, profiles of frequencies that the database counted, provenance and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import database as D
from .profile import LOW_CARDINALITY, profile_counts


def counted(spark: SparkSession, url: str, schema: str, table: str, columns: list[str], threshold: int = LOW_CARDINALITY, **options: str) -> DataFrame:
    """(column, value, n) of a table's columns, at most threshold + 1 values each; the last one's count holds those of all further values."""
    rows: list[tuple[str, str | None, int]] = []
    n, every = D.totals(spark, url, schema, table, columns, **options)
    for c, present, pairs in zip(columns, every, D.frequencies(spark, url, schema, table, columns, threshold, **options), strict=True):
        rest = present - sum(k for _, k in pairs)  # over the threshold no value is shown, so the last one may stand for the rest
        rows += [(c, v, k + (rest if i == len(pairs) - 1 else 0)) for i, (v, k) in enumerate(pairs)]
        rows.append((c, None, n - present))
    return spark.createDataFrame(rows, "column string, value string, n long").where("n > 0")


def scan_database(spark: SparkSession, url: str, config: D.ScanConfig, threshold: int = LOW_CARDINALITY) -> dict[str, DataFrame]:
    """tables, columns, profiles and gaps of a database within the caps of config.

    The lists are as long as the caps (25 tables of 100 columns), so they are read on the driver; a table costs the database one query for all totals, and one a column for frequencies, a few at a time.
    """
    tables = D.select_tables(D.catalog(spark, url, "tables", **config.options), config)
    listed = [r.asDict() for r in tables.collect()]
    found = D.limit_columns(D.catalog(spark, url, "columns", **config.options), config)
    wanted = spark.createDataFrame([(t["table_schema"], t["table_name"]) for t in listed], "table_schema string, table_name string")
    columns = found.join(F.broadcast(wanted), ["table_schema", "table_name"]).orderBy("table_schema", "table_name", "ordinal_position")
    rows = [r.asDict() for r in columns.collect()]
    parts = []
    for t in listed:
        names = [r["column_name"] for r in rows if (r["table_schema"], r["table_name"]) == (t["table_schema"], t["table_name"])]
        if names:
            counts = counted(spark, url, t["table_schema"], t["table_name"], names, threshold, **config.options)
            parts.append(profile_counts(counts, f"{t['table_schema']}.{t['table_name']}", names, threshold))
    schema = "table_schema string, table_name string, kind string, comment string"
    tables = spark.createDataFrame([tuple(t.get(c) for c in ("table_schema", "table_name", "kind", "comment")) for t in listed], schema)
    schema = "table_schema string, table_name string, column_name string, data_type string, ordinal_position int, comment string"
    columns = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
    return {"tables": tables, "columns": columns, "profiles": reduce(DataFrame.unionByName, parts) if parts else None, "gaps": gaps(tables, columns)}


def gaps(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A row a table: its source of meaning (comment or none), columns, columns with a comment, and coverage = commented / (columns + 1)."""
    said = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("int")
    of = columns.groupBy("table_schema", "table_name").agg(F.count("*").alias("n_columns"), F.sum(said("comment")).alias("commented"))
    both = tables.join(of, ["table_schema", "table_name"], "left").fillna(0, ["n_columns", "commented"])
    own = said("comment")
    share = F.round((F.col("commented") + own) / (F.col("n_columns") + 1), 4)
    return both.select("table_schema", "table_name", F.when(own == 1, "comment").otherwise("none").alias("provenance"), "n_columns", "commented", share.alias("coverage"))
