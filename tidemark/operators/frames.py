"""Window frames that Spark's SQL lacks: GROUPS frames, which count peer groups instead of rows, and all EXCLUDE forms.

Rows are aggregated to one row a peer group - equal values of the order columns within a partition - before anything is ordered. Frames of
groups then are ROWS frames over those rows; what lies before, in and behind a row's own group is put together as
the EXCLUDE form asks. A row takes itself out of its own group by subtraction (sum, count) or by its group's two smallest and largest values
(min, max). So a window orders groups, not rows, and the rows are moved once, by the join with their group.

Defined results as in the SQL standard: null order values are peers and come first; null values don't count; a frame without
values has count 0 and null otherwise. Sums are of the value's own type: give decimals or integers where they are to be exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_OTHERS, CURRENT_ROW, GROUP, TIES = "no others", "current row", "group", "ties"


def _least(*values: Column) -> Column:
    return F.array_min(F.array_compact(F.array(*values)))


def _most(*values: Column) -> Column:
    return F.array_max(F.array_compact(F.array(*values)))


def _added(*values: Column) -> Column:
    """The sum of the values that aren't null, null where all are."""
    none = values[0].isNull()
    for v in values[1:]:
        none &= v.isNull()
    total = F.coalesce(values[0], F.lit(0))
    for v in values[1:]:
        total = total + F.coalesce(v, F.lit(0))
    return F.when(~none, total)


def groups_frame(df: DataFrame, value: str, *, partition_by: Sequence[str], order_by: Sequence[str], start: int | None, end: int | None, exclude: str = NO_OTHERS, prefix: str = "frame") -> DataFrame:
    """df with {prefix}_count, _sum, _min and _max of value over GROUPS BETWEEN start AND end, EXCLUDE exclude.

    start and end count groups from the row's own one (0), negative before it; None is unbounded. order_by are ascending, nulls first.
    """
    if exclude not in (NO_OTHERS, CURRENT_ROW, GROUP, TIES):
        raise ValueError(f"exclude: {exclude}")
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    if low > high:
        raise ValueError("the frame ends before it begins")
    by = [*partition_by, *order_by]
    v = F.col("_v")
    rows = df.select(F.struct(*df.columns).alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).alias("_v"))
    keys = [f"_k{i}" for i in range(len(by))]
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_m"))  # equal values meet before the shuffle
    extremes = F.struct(v.alias("v"), F.col("_m").alias("m"))
    groups = counted.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_m"))), F.lit(0)).alias("_n"), F.sum(v * F.col("_m")).alias("_s"),
        F.min(F.when(v.isNotNull(), extremes)).alias("_a"), F.max(F.when(v.isNotNull(), extremes)).alias("_z"),
    )
    ranked = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    seconds = counted.where("_v IS NOT NULL")
    lows = seconds.withColumn("_i", F.row_number().over(ranked)).where("_i = 2").select(*[F.col(k).alias(f"_l{k}") for k in keys], F.col("_v").alias("_a2"))
    highs = seconds.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_v").desc()))).where("_i = 2").select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("_v").alias("_z2"))
    for other, p in ((lows, "_l"), (highs, "_h")):
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{p}{k}"))
        groups = groups.join(other, on, "left").drop(*[f"{p}{k}" for k in keys])
    ordered = Window.partitionBy(*keys[: len(partition_by)]).orderBy(*[F.asc_nulls_first(k) for k in keys[len(partition_by) :]])

    def over(a: int, b: int) -> list[Column | None]:
        """count, sum, min, max of the groups from a to b, or nothing where there can be none."""
        if a > b:
            return [None] * 4
        w = ordered.rowsBetween(a, b)
        return [F.sum("_n").over(w), F.sum("_s").over(w), F.min("_a.v").over(w), F.max("_z.v").over(w)]

    sides = {"_b": over(low, min(high, -1)), "_f": over(max(low, 1), high)}
    columns = {f"{p}{i}": c if c is not None else F.lit(None) for p, cs in sides.items() for i, c in enumerate(cs)}
    types = ("bigint", None, None, None)
    framed = groups.select("*", *[(c.cast(types[int(n[2:])]) if types[int(n[2:])] else c).alias(n) for n, c in columns.items()])
    framed = framed.select(*[F.col(k).alias(f"_g{k}") for k in keys], *[c for c in framed.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_g{k}"))
    joined = rows.join(framed, on)
    here = low <= 0 <= high
    alone = (F.col("_a.v") == v) & (F.col("_a.m") == 1), (F.col("_z.v") == v) & (F.col("_z.m") == 1)
    one = F.when(v.isNotNull(), 1).otherwise(0)
    null = F.lit(None)
    own = {
        NO_OTHERS: (F.col("_n"), F.col("_s"), F.col("_a.v"), F.col("_z.v")),
        CURRENT_ROW: (F.col("_n") - one, F.when(F.col("_n") - one > 0, F.col("_s") - F.coalesce(v, F.lit(0))), F.when(alone[0], F.col("_a2")).otherwise(F.col("_a.v")), F.when(alone[1], F.col("_z2")).otherwise(F.col("_z.v"))),
        GROUP: (F.lit(0), null, null, null),
        TIES: (one, v, v, v),
    }[exclude if here else GROUP]
    kind = df.schema[value].dataType
    sums = groups.schema["_s"].dataType
    out = [
        sum((F.coalesce(F.col(f"{p}0"), F.lit(0)) for p in sides), own[0]).cast("long").alias(f"{prefix}_count"),
        _added(own[1].cast(sums), *[F.col(f"{p}1").cast(sums) for p in sides]).cast(sums).alias(f"{prefix}_sum"),
        _least(own[2].cast(kind), *[F.col(f"{p}2").cast(kind) for p in sides]).alias(f"{prefix}_min"),
        _most(own[3].cast(kind), *[F.col(f"{p}3").cast(kind) for p in sides]).alias(f"{prefix}_max"),
    ]
    return joined.select(*[F.col("_row")[c].alias(c) for c in df.columns], *out)
