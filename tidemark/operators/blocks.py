"""Small tables sent to all tasks in blocks of bounded size: the sides that are searched for, such as questions or phrases."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def blocks(df: DataFrame, size: Column, most: int, *order: str) -> Iterator[list[Row]]:
    """Rows in blocks of about `most` units of size by the columns' order: one sort, and the driver holds a block at a time.

    A block begins where the running size passes a multiple of `most`; so it is over `most` by one row at the most.
    """
    rows = df.withColumn("_size", size.cast("long")).orderBy(*order)
    block, held = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=False):
        if block and held + r["_size"] > most:
            yield block
            block, held = [], 0
        block.append(r)
        held += r["_size"]
    if block:
        yield block


def empty_like(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def united(frames: list[DataFrame], df: DataFrame, schema: str) -> DataFrame:
    out = frames[0] if frames else empty_like(df, schema)
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lengths(c: str) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) + 1
