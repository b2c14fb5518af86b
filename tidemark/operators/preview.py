"""Guarded previews: policy check, a capped run, and an audit row that holds a fingerprint instead of SQL."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .guard import GuardReport, check, parse

ROWS, PAGE, MILLISECONDS = 100, 50, 60_000


@dataclass
class Preview:
    status: str
    columns: list[str] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    truncated: bool = False
    errors: list[str] = field(default_factory=list)
    audit: dict[str, Any] = field(default_factory=dict)


def fingerprint(sql: F.Column) -> F.Column:
    return F.sha2(sql, 256)


def capped(df: DataFrame, limit: int) -> DataFrame:
    """At most one row more than the limit, which tells whether the result was cut."""
    return df.limit(max(limit, 0) + 1)


def effective_limit(spark: SparkSession, sql: str, asked: int, cap: int) -> int:
    """The least of what is asked for, the cap, and a limit that the statement itself ends with."""
    root = parse(spark, sql)
    own = root.limitExpr().toString() if root.getClass().getSimpleName() == "GlobalLimit" else ""
    return max(0, min([asked, cap, *([int(own)] if own.isdigit() else [])]))


def timed_rows(spark: SparkSession, df: DataFrame, milliseconds: int) -> list[Any]:
    """Rows of a capped frame; its jobs are cancelled after the time."""
    tag = f"preview-{uuid.uuid4().hex}"
    timer = threading.Timer(milliseconds / 1000, spark.sparkContext.cancelJobsWithTag, [tag])
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def preview(spark: SparkSession, sql: str, *, allowed: list[str], blocked: list[str], role: str = "analyst", limit: int = ROWS, cap: int = ROWS, milliseconds: int = MILLISECONDS, args: dict[str, Any] | None = None) -> Preview:
    """Check, run with a cap, and describe for the audit log. A blocked statement gives no row, and any failure an audit entry.

    args are the values of named parameters (:name); Spark binds them as literals, so no value becomes SQL.
    """
    report: GuardReport = check(spark, sql, allowed, blocked, args)
    digest = spark.range(1).select(fingerprint(F.lit(sql))).head()[0]
    audit = {"id": str(uuid.uuid4()), "role": role, "sql_sha256": digest, "checks": report.checks, "tables": report.tables}
    if not report.passed:
        return Preview("blocked", errors=report.errors, audit=audit | {"status": "blocked", "row_count": 0})
    n = effective_limit(spark, sql, limit, cap)
    df = spark.sql(sql.strip().rstrip(";"), args=args or None)
    try:
        rows = timed_rows(spark, capped(df, n), milliseconds)
    except Exception as e:  # whatever ends a run is audited, without the statement
        return Preview("failed", columns=df.columns, errors=[type(e).__name__], audit=audit | {"status": "failed", "row_count": 0})
    shown = [r.asDict(recursive=True) for r in rows[:n]]
    return Preview("ok", df.columns, shown, len(rows) > n, [], audit | {"status": "ok", "row_count": len(shown)})


def page(df: DataFrame, limit: int = PAGE) -> tuple[int, DataFrame]:
    """Exact row count and one page."""
    return df.count(), df.limit(limit)
