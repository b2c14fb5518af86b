"""Nested JSON records sanitised on executors: keys that carry raw values go, at any depth; keys get safe names, texts lose personal data.

Records stay in their rows: nothing is shuffled or sent to the driver. The walk over a record is release.sanitised's, which
artifacts of the driver's size share.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..workspace import ship
from .release import sanitised, text_redacted

_LEAF = pa.struct([("path", pa.string()), ("value", pa.string())])
_FIELDS = "clean string, removed array<string>, redacted array<string>, leaves array<struct<path:string,value:string>>, error string"


def _walk(value: Any, path: str, removed: list[str], redacted: list[str]) -> None:
    """Paths of keys that go and of texts that change; a list's elements share its path with []."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if k.lower() in pii.RAW_KEYS:
                removed.append(at)
            else:
                _walk(v, at, removed, redacted)
    elif isinstance(value, list):
        for v in value:
            _walk(v, f"{path}[]", removed, redacted)
    elif isinstance(value, str) and text_redacted(value) != value:
        redacted.append(path)


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, str | None]]:
    """(path, text) of every value that holds no other, and of empty objects and lists; texts as they are, others as JSON."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from leaves(v, f"{path}[]")
    else:
        yield path, value if isinstance(value, str) or value is None else json.dumps(value)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 512):
            part, out = batch.slice(a, 512), []
            for text in part.column(1).to_pylist():
                removed, redacted = [], []
                try:
                    value = None if text is None else json.loads(text)
                    _walk(value, "", removed, redacted)
                    clean = sanitised(value)
                    flat = [{"path": p, "value": v} for p, v in leaves(clean)] if text is not None else []
                    out.append((None if text is None else json.dumps(clean, ensure_ascii=False, sort_keys=True, separators=(",", ":")), sorted(removed), sorted(redacted), flat, None))
                except (ValueError, RecursionError) as e:
                    out.append((None, [], [], [], f"{type(e).__name__}: {e}"[:200]))
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(_LEAF), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["row", "clean", "removed", "redacted", "leaves", "error"])


def clean_records(df: DataFrame, record: str) -> DataFrame:
    """df with clean (the record as JSON with sorted keys), removed and redacted (sorted paths), leaves (path, value of the clean record) and error.

    record is JSON text; use to_json for a struct, map or variant. A record with any removed path is one that a strict caller rejects. Null stays null;
    a text that isn't JSON, or is nested deeper than Python's stack, has an error and nothing else, so that it can't pass as clean.
    """
    ship(df.sparkSession)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(record).cast("string").alias("_json"))
    got = rows.mapInArrow(_cleaned, f"row {rows.schema['row'].dataType.simpleString()}, {_FIELDS}")
    return got.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in ("clean", "removed", "redacted", "leaves", "error")], "clean", "removed", "redacted", "leaves", "error")
