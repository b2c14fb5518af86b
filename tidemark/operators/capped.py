"""Profiles in bounded space: distinct values are counted up to a threshold, and frequent values found exactly, without shuffling every value.

A task keeps CAPACITY counters a column (Misra and Gries): where a column has no more values than that, its counts are exact; else the
smallest are let go and what they may have hidden is noted as the column's error. So a task hands on CAPACITY rows a column, whatever it read.
A value's true count lies between the sum of its counters and that plus all errors. Frequent values are counted once more,
exactly, among the candidates that can still be in the first n. Where the n-th count doesn't exceed what a value outside the candidates
could have - columns without frequent values, such as keys - those columns alone are counted in full.

Values longer than LONG characters are kept by their SHA-256, so that a counter is small; their text comes from the second count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import day, number, present, ratio4
from ..workspace import ship
from .blocks import united
from .profile import LOW_CARDINALITY, TOP, type_guess

CAPACITY, LONG = 1024, 64

Tables = Mapping[str, tuple[DataFrame, Sequence[str]]]


def _key(value: Column) -> Column:
    return F.when(F.length(value) <= LONG, value).otherwise(F.concat(F.lit("\u0000"), F.sha2(value, 256)))


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[present(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])


class _Counters:
    """One column's counters: keys, counts, what each key may have lost, and rows without a value."""

    def __init__(self):
        self.table = pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        self.error = self.missing = 0

    def add(self, keys: pa.Array, capacity: int) -> None:
        self.missing += keys.null_count
        got = pc.value_counts(keys.drop_null())
        both = pa.concat_tables([self.table, pa.table({"key": got.field(0).cast(pa.string()), "n": got.field(1)})])
        self.table = both.group_by("key").aggregate([("n", "sum")]).select(["key", "n_sum"]).rename_columns(["key", "n"])
        if len(self.table) > capacity:
            n = np.asarray(self.table["n"])
            cut = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
            self.error += cut
            kept = self.table.filter(pa.array(n > cut))
            self.table = pa.table({"key": kept["key"], "n": pc.subtract(kept["n"], cut)})


def _summed(batches: Iterator[pa.RecordBatch], columns: Sequence[str], capacity: int) -> Iterator[pa.RecordBatch]:
    held = [_Counters() for _ in columns]
    for batch in batches:
        for counters, column in zip(held, batch.columns, strict=True):
            counters.add(column, capacity)
    for name, c in zip(columns, held, strict=True):
        n = len(c.table)
        keys = [*c.table["key"].to_pylist(), None]
        yield pa.RecordBatch.from_arrays([pa.array([name] * (n + 1)), pa.array(keys, pa.string()), pa.array([*c.table["n"].to_pylist(), c.missing]), pa.array([0] * n + [c.error])], names=["column", "key", "n", "error"])


def counters(tables: Tables, capacity: int = CAPACITY) -> DataFrame:
    """(table, column, key, n, error): counters summed over all tasks; the row without key has the missing values and the error. One job for all tables."""
    parts = []
    for name, (df, columns) in tables.items():
        ship(df.sparkSession)
        keys = _values(df, columns).select(*[_key(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(columns))])
        rows = keys.mapInArrow(lambda it, c=tuple(columns): _summed(it, c, capacity), "column string, key string, n long, error long")
        parts.append(rows.select(F.lit(name).alias("table"), "*"))
    return united(parts, parts[0], "").groupBy("table", "column", "key").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))


def capped_counts(summed: DataFrame, threshold: int = LOW_CARDINALITY) -> DataFrame:
    """(table, column, cardinality): exact up to the threshold, threshold + 1 above it."""
    d = F.count("key")
    return summed.groupBy("table", "column").agg(F.when((F.max("error") > 0) | (d > threshold), threshold + 1).otherwise(d).cast("long").alias("cardinality"))


def _cells(tables: Tables) -> DataFrame:
    parts = []
    for name, (df, columns) in tables.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(F.col(f"`{c}`")).alias("value")) for c in columns])
        parts.append(df.select(F.lit(name).alias("table"), F.inline(pairs)))
    return united(parts, parts[0], "")


def top_values(tables: Tables, n: int = TOP, capacity: int = CAPACITY, summed: DataFrame | None = None) -> DataFrame:
    """(table, column, value, n, rank): the n most frequent present values of every column, ties by value; exact.

    Two passes over the tables; a third, with every value in a shuffle, over the columns whose n-th count is no larger than their error.
    The driver gets two numbers a column.
    """
    summed = counters(tables, capacity) if summed is None else summed
    by = ["table", "column"]
    error = summed.groupBy(*by).agg(F.max("error").alias("e"))
    real = summed.where("key IS NOT NULL").join(error, by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key"))
    floor = real.withColumn("place", place).where(F.col("place") <= n).groupBy(*by).agg(F.min("n").alias("least"), F.count("*").alias("m"))
    some = real.join(floor, by).where((F.col("m") < n) | (F.col("n") + F.col("e") >= F.col("least"))).select(*by, "key")
    cells = _cells(tables).where("value IS NOT NULL")
    found = cells.withColumn("key", _key(F.col("value"))).join(F.broadcast(some), [*by, "key"])  # capacity rows a column at most
    exact = found.groupBy(*by, "key").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)
    sure = ranked.groupBy(*by).agg(F.count("*").alias("have"), F.min("n").alias("least")).join(error, by, "right")
    open_columns = [(r["table"], r["column"]) for r in sure.where("e > 0 AND (have IS NULL OR have < %d OR least <= e)" % n).select(*by).collect()]
    out = ranked
    if open_columns:
        rest = {t: (df, [c for c in columns if (t, c) in open_columns]) for t, (df, columns) in tables.items()}
        full = _cells({t: x for t, x in rest.items() if x[1]}).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))
        full = full.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)
        names = tables[open_columns[0][0]][0].sparkSession.createDataFrame(open_columns, "table string, column string")
        out = ranked.join(F.broadcast(names), by, "left_anti").select(*by, "value", "n", "rank").unionByName(full.select(*by, "value", "n", "rank"))
    return out.select(*by, "value", "n", "rank")


def statistics(tables: Tables) -> DataFrame:
    """One row a table and column, by one aggregation whose rows are combined before the shuffle: a row a column and task is moved."""
    v = F.col("value")
    here = v.isNotNull()
    share = lambda hit: F.coalesce(F.count_if(hit) / F.count_if(here), F.lit(0.0)) >= 0.5
    empty = [(t, c) for t, (_, columns) in tables.items() for c in columns]
    spark = next(iter(tables.values()))[0].sparkSession
    named = spark.createDataFrame(empty, "table string, column string")
    got = _cells(tables).groupBy("table", "column").agg(
        F.count("*").alias("row_count"), F.count_if(~here).alias("null_count"), type_guess(v).alias("type_guess"),
        F.min(number(v)).alias("numeric_min"), F.max(number(v)).alias("numeric_max"), F.min(day(v)).alias("date_min"), F.max(day(v)).alias("date_max"),
        F.min(F.length(v)).alias("min_length"), F.max(F.length(v)).alias("max_length"), F.avg(F.length(v)).alias("avg_length"),
        share(v.rlike(pii.EMAIL_WHOLE)).alias("email_values"), share(pii.looks_like_phone(v)).alias("phone_values"),
    )
    out = named.join(got, ["table", "column"], "left").fillna(0, ["row_count", "null_count"])
    return out.fillna({"type_guess": "unknown", "email_values": False, "phone_values": False})


def profiles(tables: Tables, threshold: int = LOW_CARDINALITY, capacity: int = CAPACITY) -> DataFrame:
    """profile() of all columns of all tables in one plan, cardinality capped at threshold + 1; the counters must hold threshold + 1 values.

    Top values come from the counters where a column has no more than threshold values: they are exact there, and shown nowhere else.
    """
    if capacity <= threshold:
        raise ValueError("capacity must be above the threshold")
    by = ["table", "column"]
    summed = counters(tables, capacity)
    few = summed.where("key IS NOT NULL").join(capped_counts(summed, threshold).where(F.col("cardinality") <= threshold), by)
    text = _texts(tables, few.where(F.col("key").startswith("\u0000")).select(*by, "key"))
    few = few.join(text, [*by, "key"], "left").withColumn("value", F.coalesce("value", "key"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    best = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    best = best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))).alias("top"))
    stats = statistics(tables).join(capped_counts(summed, threshold), by, "left").fillna(0, ["cardinality"]).join(best, by, "left")
    by_value = F.array_compact(F.array(F.when(F.col("email_values"), F.lit("email")), F.when(F.col("phone_values"), F.lit("phone"))))
    stats = stats.withColumn("pii_categories", F.array_sort(F.array_union(pii.name_categories(F.col("column")), by_value))).withColumn("is_pii", F.size("pii_categories") > 0)
    safe, low = ~F.col("is_pii"), F.col("cardinality") <= threshold
    redaction = F.when(F.col("is_pii"), "raw_values_suppressed_for_pii").when(~low, "raw_values_suppressed_for_high_cardinality")
    return stats.select(
        *by, "row_count", "null_count", ratio4(F.col("null_count"), F.col("row_count")).alias("null_ratio"), "cardinality", "type_guess",
        *[F.when(safe, F.col(c)).alias(c) for c in ("numeric_min", "numeric_max", "date_min", "date_max")],
        "min_length", "max_length", F.round("avg_length", 2).alias("avg_length"), "is_pii", "pii_categories", F.when(safe & low, F.col("top")).alias("top_values"), redaction.alias("redaction"),
    )


def _texts(tables: Tables, keys: DataFrame) -> DataFrame:
    """(table, column, key, value) of long values, threshold rows a column at most."""
    cells = _cells(tables).where(F.length("value") > LONG).withColumn("key", _key(F.col("value")))
    return cells.join(F.broadcast(keys), ["table", "column", "key"]).groupBy("table", "column", "key").agg(F.first("value").alias("value"))


def all_columns(tables: Mapping[str, DataFrame]) -> Tables:
    return {t: (df, df.columns) for t, df in tables.items()}
