"""Evaluation: cases against plans, guards and rankings, and their summaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planner
from .guard import check
from .packs import Pack

RESULT = "case_id string, suite string, status string, detail string"


def summary(results: DataFrame, by: str = "suite") -> DataFrame:
    """passed, failed, skipped and total by suite."""
    return results.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")], F.count("*").alias("total"))


def golden(spark: SparkSession, packs: list[Pack], cases: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Questions whose plans must hold the expected cards; `forbidden` ones must be absent."""
    rows = []
    for c in cases:
        p = planner.plan(packs, c["question"], c.get("role"))
        got = {*p.terms, *p.metrics, *p.joins, *([p.verified_query] if p.verified_query else [])}
        missing, wrong = sorted(set(c.get("expected", ())) - got), sorted(set(c.get("forbidden", ())) & got)
        rows.append((c["id"], "golden", "failed" if missing or wrong else "passed", f"missing {missing}, forbidden {wrong}" if missing or wrong else ""))
    return spark.createDataFrame(rows, RESULT)


def red_team(spark: SparkSession, cases: Iterable[Mapping[str, Any]], allowed: list[str], blocked: list[str]) -> DataFrame:
    """Statements that the guard must stop, or, with `safe`, let through."""
    rows = []
    for c in cases:
        r = check(spark, c["sql"], allowed, blocked)
        ok = r.passed == bool(c.get("safe"))
        rows.append((c["id"], "red_team", "passed" if ok else "failed", "" if ok else "; ".join(r.errors)))
    return spark.createDataFrame(rows, RESULT)


def scenarios(spark: SparkSession, packs: list[Pack], cases: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Questions whose answer view must be in an expected state."""
    from ..service import answer

    rows = []
    for c in cases:
        view = answer(spark, packs, c["question"], role=c.get("role", "analyst"))
        ok = view["state"] == c["state"]
        rows.append((c["id"], "scenario", "passed" if ok else "failed", "" if ok else view["state"]))
    return spark.createDataFrame(rows, RESULT)
