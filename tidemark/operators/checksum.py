"""Checksum of a table's ordered rows as a hash tree of a stated fan-out; the root doesn't depend on how rows are spread.

Rows are sorted by ranges of the order columns and their own hash and written once. A range's first place is the count of
rows in the ranges before it, one row a range; so each row knows its place without a window over the table. A leaf is the SHA-256 of the
hex hashes of FAN_OUT neighbours, one after the other, and so on up to one node. No task holds more than FAN_OUT hashes of a node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

FAN_OUT = 1024


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the cells' texts in order; a cell is its length, a colon and its text, null is a hyphen."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.sha2(F.concat_ws("", *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)


def placed(df: DataFrame, order_by: Sequence[str | Column], ws: Workspace) -> DataFrame:
    """(place, h): each row's hash and its place from 0, by the order columns (names: nulls first) and the hash."""
    keys = [F.asc_nulls_first(F.col(f"`{c}`")) if isinstance(c, str) else c for c in order_by]
    rows = df.withColumn("_h", row_hash(df.columns))
    order = [*keys, F.asc("_h")]
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("nth"), F.col("_h").alias("h"))
    cut = ws.keep(cut, "ordered")
    counts = cut.groupBy("range").agg(F.count("*").alias("n"), F.min("nth").alias("low"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = counts.select(F.col("range").alias("r"), "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return cut.join(F.broadcast(first), F.col("range") == F.col("r")).select((F.col("first") + F.col("nth") - F.col("low")).alias("place"), "h")


def table_checksum(df: DataFrame, order_by: Sequence[str | Column], fan_out: int = FAN_OUT, most_levels: int | None = None) -> DataFrame:
    """One row: n_rows, levels (of nodes above the rows), root (64 hex digits) and checksum (its first 16). No rows: root of the empty text, no level.

    With most_levels the tree ends there: one row for each of its top nodes, which together cover all rows; no rows: none.
    """
    ws = Workspace(df.sparkSession, "checksum")
    level = placed(df, order_by, ws)
    n = rows = level.count()
    levels = 0
    while (n > 1 or (levels == 0 and n)) and (most_levels is None or levels < most_levels):
        node = level.groupBy((F.col("place") / fan_out).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("c"))
        level = ws.keep(node.select(F.col("node").alias("place"), F.sha2(F.array_join(F.col("c.h"), ""), 256).alias("h")), "level")
        n, levels = -(-n // fan_out), levels + 1
    top = level.select("h") if rows or most_levels is not None else df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("h"))
    return top.select(F.lit(rows).cast("long").alias("n_rows"), F.lit(levels).alias("levels"), F.col("h").alias("root"), F.substring("h", 1, 16).alias("checksum"))
