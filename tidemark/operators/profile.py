"""Column profiles: one row a column, from one pass over the table, without raw values of personal data.

All statistics are over trimmed texts of present values. Exact distinct counts make one shuffle of
(column, value, count) rows after partial aggregation; a frequent value is one row a task there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import day, number, present, ratio4

TOP, LOW_CARDINALITY, SAMPLE = 5, 20, 50
BOOLEANS = ("true", "false", "0", "1", "yes", "no", "y", "n")


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value): a row for each cell of the chosen columns; value is null where missing."""
    chosen = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(F.col(f"`{c}`")).alias("value")) for c in chosen])
    return df.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): frequencies; one row of null value holds the missing ones."""
    return cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def totals(counts: DataFrame) -> DataFrame:
    """column, row_count, null_count, distinct_count from value counts."""
    return counts.groupBy("column").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("value").alias("distinct_count")
    )


def top_values(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The n most frequent present values of each column, ties by value."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def type_guess(value: Column, weight: Column | None = None) -> Column:
    """Aggregate: number if all present values are, else date, else boolean, else string; unknown without any."""
    has = F.count(value) == 0
    numbers, dates = F.every(number(value).isNotNull() | value.isNull()), F.every(day(value).isNotNull() | value.isNull())
    booleans = F.every(F.lower(value).isin(*BOOLEANS) | value.isNull())
    return F.when(has, "unknown").when(numbers, "number").when(dates, "date").when(booleans, "boolean").otherwise("string")


def profile(df: DataFrame, table: str, columns: Sequence[str] | None = None, low_cardinality: int = LOW_CARDINALITY) -> DataFrame:
    """One row a column: counts, ratio, cardinality, type, extrema, lengths, PII verdict, safe top values, join-key candidacy.

    Personal data by name is judged for every column, whatever its cardinality. By value, a column is
    personal if at least half of all its present values match, not of the first few alone: rows of a distributed table have no order. Columns of an
    empty table have a row too: no value, ratio 0, type unknown.
    """
    return profile_counts(value_counts(df, columns), table, list(columns or df.columns), low_cardinality)


def profile_counts(counts: DataFrame, table: str, columns: Sequence[str], low_cardinality: int = LOW_CARDINALITY) -> DataFrame:
    """profile() from (column, value, n) frequencies, wherever they were counted."""
    names = counts.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    empty = names.select("column", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    counts = counts.select("column", "value", F.col("n").cast("long").alias("n")).unionByName(empty)
    v = F.col("value")
    here = v.isNotNull()
    share = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))) / F.sum(F.when(here, F.col("n"))), F.lit(0.0)) >= 0.5
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(v).alias("cardinality"),
        type_guess(v).alias("type_guess"),
        F.min(number(v)).alias("numeric_min"), F.max(number(v)).alias("numeric_max"),
        F.min(day(v)).alias("date_min"), F.max(day(v)).alias("date_max"),
        F.min(F.length(v)).alias("min_length"), F.max(F.length(v)).alias("max_length"),
        (F.sum(F.length(v) * F.col("n")) / F.sum(F.when(here, F.col("n")))).alias("avg_length"),
        share(v.rlike(pii.EMAIL_WHOLE)).alias("email_values"), share(pii.looks_like_phone(v)).alias("phone_values"),
    )
    by_value = F.array_compact(F.array(F.when(F.col("email_values"), F.lit("email")), F.when(F.col("phone_values"), F.lit("phone"))))
    named = pii.name_categories(F.col("column"))
    stats = stats.withColumn("pii_categories", F.array_sort(F.array_union(named, by_value))).withColumn("is_pii", F.size("pii_categories") > 0)
    n = pii.column_name(F.col("column"))
    safe = ~F.col("is_pii")
    best = top_values(counts).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))).alias("top"))
    joined = stats.join(best, "column", "left")
    shown = safe & (F.col("cardinality") <= low_cardinality)
    redaction = F.when(F.col("is_pii"), "raw_values_suppressed_for_pii").when(F.col("cardinality") > low_cardinality, "raw_values_suppressed_for_high_cardinality")
    return joined.select(
        F.lit(table).alias("table"), "column", "row_count", "null_count", ratio4(F.col("null_count"), F.col("row_count")).alias("null_ratio"), "cardinality", "type_guess",
        *[F.when(safe, F.col(c)).alias(c) for c in ("numeric_min", "numeric_max", "date_min", "date_max")],
        "min_length", "max_length", F.round("avg_length", 2).alias("avg_length"), "is_pii", "pii_categories",
        F.when(shown, F.col("top")).alias("top_values"), redaction.alias("redaction"),
        ((F.col("row_count") > 0) & (F.col("null_count") == 0) & n.endswith("id") & (F.col("cardinality") == F.col("row_count"))).alias("join_key_candidate"),
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of several tables in one frame."""
    return reduce(DataFrame.unionByName, [profile(df, name) for name, df in tables.items()])


def within_first(df: DataFrame, key: str, column: str, n: int = SAMPLE) -> DataFrame:
    """The first n present values of a column by key: what value patterns are tested on."""
    return df.select(key, present(F.col(column)).alias("value")).where("value is not null").orderBy(key).limit(n)
