"""Profiles of a stream that grow with each batch: sketches in Spark's keyed state, by transformWithState.

A key's state is one sketch (functions.sketches): counts, extrema, distinct values, quantiles, frequent values; its size doesn't grow
with the rows. A hot key is dealt over `salts` states, whose sketches `folded` puts together. With event time, a
key that no row came for during `idle` is reported once more as closed and its state is dropped; with processing time, state lives for
`ttl_ms`. State is in RocksDB and in the query's checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import sketches as S
from ..workspace import ship

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PROFILE = "rows long, nulls long, low double, high double, distinct long, median double, p95 double, frequent array<struct<value: string, count: long>>, error long"


class _Profiler(StatefulProcessor):
    """Folds a key's rows (value, item, ms) into its sketch."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sketch", S.SCHEMA, self.ttl_ms)

    def _out(self, key: tuple, sketch: S.Sketch, closed: bool) -> pd.DataFrame:
        names = ["key", "salt", *S.Sketch._fields, "closed"]
        return pd.DataFrame([[*key, *S.row(sketch), closed]], columns=names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sketch = S.from_row(self.state.get()) if self.state.exists() else S.Sketch()
        last = None
        for batch in rows:
            sketch = S.merged(sketch, S.of(batch["value"], batch["item"]))
            if self.idle_ms is not None:
                top = batch["ms"].max()
                last = top if last is None or top > last else last
        self.state.update(S.row(sketch))
        if self.idle_ms is not None and last is not None and not pd.isna(last):
            timers = [t for t in self.handle.listTimers()]
            due = max([int(last) + self.idle_ms, *timers])
            for t in timers:
                if t != due:
                    self.handle.deleteTimer(t)
            if due not in timers:
                self.handle.registerTimer(due)
        yield self._out(key, sketch, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            sketch = S.from_row(self.state.get())
            self.state.clear()
            yield self._out(key, sketch, True)

    def close(self) -> None:
        pass


def _sketch_schema(key_type: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(f"key {key_type}, salt int, {S.SCHEMA}, closed boolean")


def _rows(events: DataFrame, key: str, value: str, item: str, time: str | None, salts: int) -> DataFrame:
    ms = F.lit(None).cast("long") if time is None else F.unix_millis(F.col(time).cast("timestamp"))
    salt = F.pmod(F.xxhash64(value, item, *([time] if time else [])), F.lit(salts)).cast("int")
    columns = [F.col(key).alias("key"), salt.alias("salt"), F.col(value).cast("double").alias("value"), F.col(item).cast("string").alias("item"), ms.alias("ms")]
    return events.select(*columns, *([F.col(time).cast("timestamp").alias("at")] if time else []))


def stream_sketches(events: DataFrame, *, key: str, value: str, item: str, time: str | None = None, idle: str | None = None, late: str = "10 minutes", salts: int = 1, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key, salt, sketch columns, closed): the state of each key that a batch touched. Write it in update mode.

    time and idle: event time, and after how long without rows a key is closed (a time such as "2 days"). Needs the RocksDB state store.
    """
    spark = events.sparkSession
    ship(spark)
    if spark.conf.get(ROCKS[0], "") != ROCKS[1]:
        raise ValueError(f"set {ROCKS[0]} to {ROCKS[1]}")
    rows = _rows(events, key, value, item, time, salts)
    idle_ms = None if idle is None else spark.range(1).selectExpr(f"unix_millis(timestamp_millis(0) + interval {idle})").head()[0]
    mode = "None" if time is None and ttl_ms is None else "ProcessingTime" if time is None else "EventTime"
    if time is not None:
        rows = rows.withWatermark("at", late)
    processor = _Profiler(idle_ms, ttl_ms)
    return rows.groupBy("key", "salt").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_sketch_schema(rows.schema["key"].dataType.simpleString()), outputMode="Update", timeMode=mode)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows to one sketch a key."""
    held: dict[Any, S.Sketch] = {}
    for batch in batches:
        for key, rows in batch.groupby("key", dropna=False, sort=False):
            name = None if pd.isna(key) else key
            held[name] = S.merged(held.get(name, S.Sketch()), S.of(rows["value"], rows["item"]))
    if held:
        yield pd.DataFrame([[k, 0, *S.row(s), False] for k, s in held.items()], columns=["key", "salt", *S.Sketch._fields, "closed"])


def batch_sketches(events: DataFrame, *, key: str, value: str, item: str) -> DataFrame:
    """The same rows from a table, a sketch for each task and key."""
    ship(events.sparkSession)
    rows = _rows(events, key, value, item, None, 1).select("key", "value", "item")
    return rows.mapInPandas(_partial, _sketch_schema(rows.schema["key"].dataType.simpleString()))


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    sketch = S.Sketch()
    for r in frame[list(S.Sketch._fields)].itertuples(index=False, name=None):
        sketch = S.merged(sketch, S.from_row(r))
    key = frame["key"].iloc[0]
    out = [key, sketch.rows, sketch.nulls, sketch.low, sketch.high, S.distinct(sketch), S.quantile(sketch, 0.5), S.quantile(sketch, 0.95), S.frequent(sketch), sketch.error]
    return pd.DataFrame([out], columns=["key", "rows", "nulls", "low", "high", "distinct", "median", "p95", "frequent", "error"])


def folded(sketches: DataFrame) -> DataFrame:
    """One profile a key of its sketches: a few, each of bounded size, one a task or salt."""
    kind = sketches.schema["key"].dataType.simpleString()
    return sketches.groupBy("key").applyInPandas(_fold, f"key {kind}, {PROFILE}")


def latest(updates: DataFrame) -> DataFrame:
    """The last state of each key and salt among the rows that a sink has gathered: the one of the most rows. For streams whose keys aren't closed."""
    fields = [c for c in updates.columns if c not in ("key", "salt")]
    best = updates.groupBy("key", "salt").agg(F.max_by(F.struct(*fields), F.struct("rows", "closed")).alias("s"))
    return best.select("key", "salt", "s.*")
