"""The N best rows of every group, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import lookup_join
from millrace.session import use_checkpoints

#: A group is heavy if it holds more than this share of all rows, and some
#: thousands, or more rows than one task should order.
HEAVY_SHARE, LEAST_ROWS, HEAVY_ROWS = 0.02, 4_000, 100_000
#: Rows that one range of the heavy groups should hold.
RANGE_ROWS = 100_000
#: Heavy groups that are listed to the driver; more stay a table.
LISTED = 10_000


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``; null keys are dropped."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return kept.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def top_n(rows: DataFrame, groups: list[str], score: str, tie: str, n: int, heavy_rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The n rows with the highest score of each group, equal scores by ``tie``.

    Groups are counted exactly, and those are heavy that stand out among all:
    more than a fiftieth of the rows, so at most fifty, or HEAVY_ROWS
    (``heavy_rows`` replaces both). Light groups take an ordinary window. Rows of
    heavy groups are sorted into ranges over (group, salt of the score order,
    tie), each range keeps n rows of each of its groups, and a window over
    those is final; so no task sees a whole heavy group. Rows with a null or
    NaN score or a null group column are in no group's result; -0.0 equals
    0.0. Groups with fewer than n rows give all; no rows give none. ``tie``
    should be unique within a group, repeated rows count as rows.
    """
    ranked = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    for g in groups:
        ranked = ranked.where(F.col(g).isNotNull())
    ranked = ranked.withColumn("_s", F.col(score) + F.lit(0.0))
    order = [F.desc("_s"), F.asc(tie)]
    if heavy_rows is None:
        heavy_rows = min(HEAVY_ROWS, max(LEAST_ROWS, int(HEAVY_SHARE * ranked.count())))
    sizes = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= heavy_rows)
    heavy = sizes.limit(LISTED + 1).collect()
    heavy = heavy if len(heavy) <= LISTED else None
    if heavy == []:
        return _window(ranked, groups, order, n).drop("_s")
    spark = rows.sparkSession
    table = spark.createDataFrame(heavy, sizes.schema) if heavy else sizes
    total = sum(r["_n"] for r in heavy) if heavy else sizes.agg(F.sum("_n").alias("n")).first()["n"]
    marked = lookup_join(ranked, table, groups)
    light = _window(marked.where(F.col("_n").isNull()).drop("_n"), groups, order, n)
    hot = marked.where(F.col("_n").isNotNull()).drop("_n")
    ranges = max(2, -(-total // range_rows))
    sorted_rows = hot.repartitionByRange(int(ranges), *[F.col(g) for g in groups], *order).withColumn("_range", F.spark_partition_id())
    first = _window(sorted_rows, [*groups, "_range"], order, n).drop("_range")
    return light.unionByName(_window(first, groups, order, n)).drop("_s")


def _window(rows: DataFrame, groups: list[str], order: list, n: int) -> DataFrame:
    # the rank limit below becomes a partial limit before the shuffle as well
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def best_decisions(decisions: DataFrame, n: int = 3) -> DataFrame:
    """The n best scored decisions of every branch, step and lane, each
    decision as its latest row has it."""
    use_checkpoints(decisions.sparkSession)
    rows = decisions.select("decision_id", "seq", "branch_id", "step", "lane", "opus_score")
    # read for the counts and again for the ranking
    last = latest(rows, "decision_id", "seq").where(F.col("opus_score").isNotNull() & F.col("lane").isNotNull()).drop("seq").checkpoint()
    return top_n(last, ["branch_id", "step", "lane"], "opus_score", "decision_id", n)
