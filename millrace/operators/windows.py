"""Ordered computations over groups that may be larger than a task should see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import lookup_join

#: Rows that a stretch should hold.
STRETCH_ROWS = 4096


def stretches(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with ``_stretch``: stretches of the order that hold about
    STRETCH_ROWS rows each, however far apart the numbers of a group lie. The
    groups' ranges and sizes, a row per group, are read first."""
    span = rows.groupBy(*keys).agg(F.min(order).alias("_lo"), F.greatest(F.lit(1.0), (F.max(order).cast("double") - F.min(order)) / F.count(F.lit(1)) * STRETCH_ROWS).alias("_width"))
    joined = lookup_join(rows, span, keys)
    return joined.withColumn("_stretch", F.floor((F.col(order).cast("double") - F.col("_lo")) / F.col("_width"))).drop("_lo", "_width")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, width: float | None = 4096, stretch: Column | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over the group's rows up to and with each.

    Rows are ordered by ``order``, whose first column is a number and should
    make, with the others, a total order. The group is cut into stretches of
    that number; sums of whole stretches are carried over, so that a task
    orders one stretch only. ``width`` suits numbers that follow each other
    closely; with None it follows from each group's range and size. Another
    ``stretch`` can be given; it must follow the order. Null values count as 0.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    if width is None and stretch is None:
        cut = stretches(rows, keys, order[0])
    else:
        cut = rows.withColumn("_stretch", F.floor(F.col(order[0]) / width) if stretch is None else stretch)
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn(out, F.sum(amount).over(inside)).join(carried, [*keys, "_stretch"]).withColumn(out, F.col(out) + F.col("_carried")).drop("_stretch", "_carried")


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, width: int = 4096) -> DataFrame:
    """``out``: the greatest non-null ``value`` up to and with each row, by
    the same stretches as ``running_sum``."""
    cut = rows.withColumn("_stretch", F.floor(F.col(order[0]) / width))
    tops = cut.groupBy(*keys, "_stretch").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_stretch", F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn(out, F.max(value).over(inside)).join(carried, [*keys, "_stretch"]).withColumn(out, F.greatest(out, "_carried")).drop("_stretch", "_carried")


def previous(rows: DataFrame, keys: list[str], order: str, values: list[str], width: int = 4096) -> DataFrame:
    """Adds prev_<value> of the row before in the group, null for the first.

    ``order`` is a number that is unique in the group. Like ``running_sum``,
    over stretches, of which each hands its last row on to the next.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / width))
    last = cut.groupBy(*keys, "_stretch").agg(F.max_by(F.struct(*values), F.col(order)).alias("_last"))
    carried = last.select(*keys, "_stretch", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_stretch")).alias("_before"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order)
    out = cut.withColumn("_here", F.lag(F.struct(*values)).over(inside)).join(carried, [*keys, "_stretch"])
    for v in values:
        out = out.withColumn(f"prev_{v}", F.when(F.col("_here").isNotNull(), F.col("_here")[v]).otherwise(F.col("_before")[v]))
    return out.drop("_stretch", "_here", "_before")
