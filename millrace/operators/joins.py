"""Joins that stay balanced when a key is hot and broadcast only what is small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast if all its rows, as text, take no more than this.
BROADCAST_BYTES = 32 << 20
#: Rows of one key on the left side from which the key counts as hot.
HOT_ROWS = 200_000
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows written as text, an upper bound to within a small factor."""
    width = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(4)) + F.lit(8) for c in df.columns))
    return df.select(F.sum(width.cast("long")).alias("n")).first()["n"] or 0


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def _equal(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c] == right[c] for c in on))


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join to a table that has one row per key.

    The right side is broadcast if its measured size allows. Beyond that the
    left rows of each key are spread over ``salts`` partitions, to each of
    which the key's single right row is copied, so that no key, null keys
    included, makes one large task.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    if is_small(right, limit):
        return left.join(F.broadcast(right), on, how)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in left.columns]), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", spread)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Join to a large table that has one row per key.

    ``rows``: how many the left side has, if that is known; with no more than
    ``hot_rows`` no key can be hot.
    Keys with more than ``hot_rows`` left rows are counted out first; there are
    at most (left rows / hot_rows) of them, and their right rows go to
    ``lookup_join``. All other keys take an ordinary shuffled join.
    """
    if rows is not None and rows <= hot_rows:
        return left.join(right, on, how)
    counts = left.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > hot_rows).select(on)
    hot = counts.checkpoint() if counts.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else counts
    if hot.isEmpty():
        return left.join(right, on, how)
    marked = lookup_join(left, hot.withColumn("_hot", F.lit(True)), [on])
    hot_right = right.join(F.broadcast(hot) if is_small(hot) else hot, on, "left_semi")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, on, how)
    heavy = lookup_join(marked.where(F.col("_hot")).drop("_hot"), hot_right, [on], how)
    return cold.unionByName(heavy)
