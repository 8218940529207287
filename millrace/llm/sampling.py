"""Bounded samples for fitting, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = float(1 << 62)


def by_group(rows: DataFrame, group: Column, key: str, most: int, keep: list[str]) -> DataFrame:
    """(group, rank, key, keep): at most ``most`` rows of each group, those
    with the least hashes of their key.

    The groups must be a fixed list (languages); their exact sizes are read
    first, so that about twice ``most`` rows of a group are moved and ranked,
    however many it has. Null keys and repeated ones are rows like others.
    """
    sizes = {r["g"]: r["n"] for r in rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    named = rows.select(group.alias("group"), key, *keep).withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.col(key)), 2))
    limit = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(int(min(1.0, 2.0 * most / n) * _SPACE)))]) if sizes else F.create_map(F.lit(""), F.lit(0))
    few = named.where(F.col("_h") <= F.try_element_at(limit, F.col("group")))
    order = Window.partitionBy("group").orderBy("_h", key)
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_h")
