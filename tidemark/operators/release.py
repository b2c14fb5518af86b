"""Artifacts that leave the house: scan of their lines for secrets, redaction with counts, nested records without raw values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii

_KEY = re.compile(r"[^0-9A-Za-z_.-]+")
#: Fields of a column's profile that show values.
SHOWN = ("top_values", "numeric_min", "numeric_max", "date_min", "date_max")


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, line, pattern) of every line of the files below a path that holds what it must not; lines count from 1. The text isn't returned."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    lines = lines.where(F.col("text").rlike("|".join(f"(?:{p})" for p in pii.SECRETS.values())))  # few lines hold any
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in pii.SECRETS.items()]))
    return lines.select("path", (F.col("line") + 1).alias("line"), F.explode(hits).alias("pattern"))


def redacted(text: Column, mark: str = "<redacted_{}>") -> Column:
    """A struct of the text without secrets and a count for each pattern; a pattern counts what those before it left."""
    counts = []
    for name, pattern in pii.SECRETS.items():
        counts.append(F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).alias(name))
        text = F.regexp_replace(text, pattern, mark.format(name))
    return F.struct(text.alias("text"), F.struct(*counts).alias("counts"))


def sanitised(value: Any) -> Any:
    """A nested record without keys that carry raw values, with safe key names and redacted texts. For artifacts of the driver's size."""
    if isinstance(value, Mapping):
        kept = {(_KEY.sub("_", str(k)).strip("_") or "field"): sanitised(v) for k, v in value.items() if str(k).lower() not in pii.RAW_KEYS}
        return kept
    if isinstance(value, (list, tuple)):
        return [sanitised(v) for v in value]
    return text_redacted(value) if isinstance(value, str) else value


def text_redacted(text: str) -> str:
    return re.sub(pii.PHONE, "<redacted_phone>", re.sub(pii.EMAIL, "<redacted_email>", text))


def without_stale_values(profiles: DataFrame) -> DataFrame:
    """Profiles whose personal columns show no value, also where they were judged after they had been profiled."""
    here = [c for c in SHOWN if c in profiles.columns]
    return profiles.withColumns({c: F.when(~F.coalesce("is_pii", F.lit(False)), F.col(c)) for c in here})


def namespaced(sources: Mapping[str, Iterable[str]]) -> list[tuple[str, str, str]]:
    """(source, table, name): tables of several sources under names of their own, source__table; collisions get _2, _3 and so on in order."""
    seen: dict[str, int] = {}
    out = []
    for source, tables in sources.items():
        for t in tables:
            name = re.sub(r"[^0-9a-z_]+", "_", f"{source}__{t}".lower()).strip("_")
            seen[name] = seen.get(name, 0) + 1
            out.append((source, t, name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return out
