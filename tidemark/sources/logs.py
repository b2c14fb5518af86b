"""Append-only JSON logs - audit, feedback, baseline candidates - without raw personal data, and reports."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii

AUDIT = "id string, at timestamp, kind string, space_id string, payload string"


class UnsafeEntry(ValueError):
    """An entry that holds personal data, or names a path outside its log."""


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("."):
        raise UnsafeEntry(f"not a log name: {name!r}")
    return name


def append(spark: SparkSession, root: str, space_id: str, kind: str, payload: dict[str, Any], redact: bool = True) -> str:
    """Add an entry and return its id. Personal data is redacted, or refused with redact=False."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False, default=str)
    row = spark.createDataFrame([(kind, safe_name(space_id), text)], "kind string, space_id string, payload string")
    if not redact and row.where(pii.has_pii(F.col("payload"))).head():
        raise UnsafeEntry("the entry holds personal data")
    row = row.withColumn("payload", pii.redact(F.col("payload"))).withColumn("at", F.current_timestamp())
    row = row.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "kind", "payload", F.col("at").cast("string")), 256), 1, 16))
    entry = spark.createDataFrame(row.collect(), row.schema)  # one entry, fixed before it is written
    entry.coalesce(1).write.mode("append").json(f"{root}/{kind}")
    return entry.head()["id"]


def read(spark: SparkSession, root: str, kind: str, space_id: str | None = None) -> DataFrame:
    df = spark.read.schema(AUDIT).json(f"{root}/{safe_name(kind)}")
    return df if space_id is None else df.where(F.col("space_id") == space_id)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON Lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report table; rows are summaries, a thousand at most are shown."""
    rows = df.limit(limit).collect()
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(str(v) for v in r)} |\n" for r in rows)
