"""Numbering rows without bringing them to one task.

Rows are dealt by ranges of the order and sorted there; only the number of rows
in each range (and group) is summed up.  The sorted rows are written to the
shared folder first, as ranges are found by sampling and would differ the next
time they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import written

TIE, PART, AT, BASE, TOTAL = "__tie", "__part", "__at", "__base", "__total"
#: Up to so many (range, group) counts are broadcast.
FEW = 100_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls are equal; the keys are those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*(f"__{k}" for k in keys))


def summed_before(counts: DataFrame, n: str, order: str, group: list[str]) -> Column:
    """The sum of ``n`` over what comes before in ``order``; meant for one row for each range, not for rows."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def bounded(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` with a hint to broadcast it if it is counted to have ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, place: str = "place", total: str | None = None) -> DataFrame:
    """``df`` with ``place``: 0, 1, ... in ``order`` (nulls first) within each ``group``; ``total`` names a column for the group's rows.

    Every row gets a place: nulls in the order are the smallest values, nulls in
    the group are a group; of rows that tie one comes first, which one is not
    defined.  A value or group that holds most of the rows is dealt to many
    tasks.  An empty table gives an empty one.
    """
    group = group or []
    keys = [F.asc_nulls_first(c) for c in (*group, *order, TIE)]
    dealt = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    told = dealt.drop(TIE).withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()})
    told = written(told, "numbered")
    counts = told.groupBy(*group, PART).agg(F.count("*").alias("__n"), F.min(AT).alias("__first"))
    sums = {BASE: summed_before(counts, "__n", PART, group) - F.col("__first")}
    if total:
        sums[TOTAL] = F.sum("__n").over(Window.partitionBy(*group))
    bases = written(counts.withColumns(sums).drop("__n", "__first"), "ranges")
    rows = null_safe(told, bounded(bases), [*group, PART]).withColumn(place, F.col(AT) + F.col(BASE))
    if total:
        rows = rows.withColumn(total, F.col(TOTAL))
    return rows.drop(PART, AT, BASE, TOTAL)
