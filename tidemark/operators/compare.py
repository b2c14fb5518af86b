"""Comparing a draft statement with a trusted one by their plans, and scoring how much of a meaning it covers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guard import READS, _kind, check, parse, profile_sql

DATE_PARTS = ("date", "time", "day", "month")


def shape(spark: SparkSession, sql: str) -> tuple[bool, bool]:
    """Whether a statement only reads, and whether its root is a limit."""
    try:
        plan = parse(spark, sql)
    except Exception:  # whatever the parser refuses isn't a statement
        return False, False
    return bool(READS.match(_kind(plan))), _kind(plan) == "GlobalLimit"


def coverage(need: Column, have: Column, doubt: Column) -> Column:
    """Share of what is needed, to three decimals; 0.75 at most where the parse is in doubt."""
    s = F.size(F.array_intersect(need, have)) / F.size(need)
    return F.floor(F.when(doubt, F.least(F.lit(0.75), s)).otherwise(s) * 1000 + F.lit(0.5)) / F.lit(1000.0)


def differences(draft: dict[str, Any], trusted: dict[str, Any]) -> list[str]:
    """What a draft's profile lacks or changes against a trusted one."""
    dates = lambda p: {f for f in p["filters"] if any(d in f for d in DATE_PARTS)}
    found = []
    if dates(trusted) and dates(draft) != dates(trusted):
        found.append("date_basis")
    if missing := set(trusted["filters"]) - set(draft["filters"]) - dates(trusted):
        found.append(f"value_filter: {', '.join(sorted(missing))}")
    if set(trusted["aggregates"]) != set(draft["aggregates"]):
        found.append("metric_basis")
    if draft["joins"] != trusted["joins"] or set(draft["tables"]) != set(trusted["tables"]):
        found.append("join")
    return found


def results(draft: DataFrame, trusted: DataFrame, digits: int = 6) -> DataFrame:
    """One row: draft_rows, trusted_rows, only_draft, only_trusted, equal - of two results as bags of rows, whatever their order and names.

    Columns are matched by place, floating point numbers by `digits` decimals. Rows are hashed and counted with opposite signs
    before the shuffle, so no result is collected or sorted. Results of different widths are never equal: all rows are on one side only.
    """

    def keyed(df: DataFrame, sign: int) -> DataFrame:
        cells = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            c = F.round(c.cast("double"), digits) + F.lit(0.0) if f.dataType.typeName() in ("float", "double", "decimal", "byte", "short", "integer", "long") else c.cast("string")
            cells.append(F.coalesce(c.cast("string"), F.lit("\u0000")))
        row = F.concat_ws("\u001f", F.lit(str(len(cells))), *cells)
        return df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"), F.lit(sign).alias("sign"))

    both = keyed(draft, 1).unionByName(keyed(trusted, -1))
    each = both.groupBy("a", "b").agg(F.sum("sign").alias("n"), F.count_if(F.col("sign") > 0).alias("d"), F.count_if(F.col("sign") < 0).alias("t"))
    none = lambda c: F.coalesce(c, F.lit(0))
    out = each.agg(none(F.sum("d")).alias("draft_rows"), none(F.sum("t")).alias("trusted_rows"), none(F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("only_draft"), none(F.sum(F.when(F.col("n") < 0, -F.col("n")))).alias("only_trusted"))
    return out.withColumn("equal", (F.col("only_draft") == 0) & (F.col("only_trusted") == 0))


def compare_results(spark: SparkSession, sql: str, trusted: str, allowed: list[str], blocked: list[str]) -> DataFrame:
    """results() of a draft that passes the guard and of the trusted statement."""
    report = check(spark, sql, allowed, blocked)
    if not report.passed:
        raise PermissionError("; ".join(report.errors))
    return results(spark.sql(sql), spark.sql(trusted))


def compare(spark: SparkSession, sql: str | None, trusted: str, allowed: list[str], blocked: list[str]) -> dict[str, Any]:
    """Differences of a draft, and whether to use it, ask, or reject it."""
    if not sql:
        return {"differences": ["no_draft"], "recommendation": "ask"}
    report = check(spark, sql, allowed, blocked)
    if not report.passed:
        return {"differences": report.errors, "recommendation": "reject"}
    found = differences(profile_sql(spark, sql), profile_sql(spark, trusted))
    return {"differences": found, "recommendation": "ask" if found else "use"}
