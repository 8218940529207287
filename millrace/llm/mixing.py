"""Mixing sources to target weights under caps on their repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import SALTS, is_small, lookup_join
from millrace.session import use_checkpoints

#: Exponent by which supplies become weights below the lanes.
TEMPER = 0.7
#: Documents of a leaf in one bucket of its epoch order.
BUCKET_ROWS = 50_000


def plain(column: Column) -> Column:
    """A lane's name without case, underscores, hyphens and spaces."""
    return F.regexp_replace(F.lower(column), r"[_\- ]", "")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Share each parent's ``budget`` out to its children.

    children: parent columns, child, weight, cap and budget (the parent's, the
    same in all its rows); optionally ``asked``, what the child is to get if
    nobody is short, which otherwise follows from the weights. A child gets no
    more than its cap; what it is short of goes to its siblings by weight, and
    what all children together are short of stays unspent here, since the
    parent was given no more than its children's caps. Adds asked, granted and
    short. A null cap is an unknown supply: no limit, never short. Children
    with weight 0 or null get nothing. Equal cases are ordered by name.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double")
    rows = children.withColumn("_w", weight).withColumn("_c", F.coalesce(F.col("cap").cast("double"), F.lit(float("inf"))))
    rows = rows.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).otherwise(F.lit(float("inf"))))
    group = Window.partitionBy(*parent)
    order = group.orderBy("_ratio", child)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_w").over(group)
    # the level up to which children are filled if all with lower ratios are full
    finite = F.when((F.col("_c") == float("inf")) | (F.col("_w") <= 0), 0.0).otherwise(F.col("_c"))
    rows = rows.withColumn("_total", total).withColumn("_level", (F.col("budget") - F.coalesce(F.sum(finite).over(earlier), F.lit(0.0))) / F.nullif(F.col("_total") - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_open", F.col("_ratio") > F.col("_level"))
    final = F.min(F.when(F.col("_open") & (F.col("_w") > 0), F.struct("_ratio", F.col(child), "_level"))).over(group)
    by_weight = F.coalesce(F.try_divide(F.col("budget") * F.col("_w"), F.col("_total")), F.lit(0.0))
    asked = F.col("asked").cast("double") if "asked" in children.columns else by_weight
    granted = F.when(F.col("_w") <= 0, 0.0).when(F.col("_final").isNull(), F.col("_c")).otherwise(F.least(F.col("_c"), F.col("_w") * F.greatest(F.col("_final._level"), F.lit(0.0))))
    out = rows.withColumn("_final", final).withColumn("asked", asked).withColumn("granted", granted).withColumn("short", F.coalesce(F.col("asked") > F.col("cap"), F.lit(False)))
    return out.drop("_w", "_c", "_ratio", "_total", "_level", "_open", "_final")


def budget_tree(leaves: DataFrame, roots: list[str], path: list[str], temper: float = TEMPER) -> DataFrame:
    """Share budgets out level by level, from the roots down a path of columns.

    leaves: roots, path columns, ``budget`` (of the root), ``weight`` (of the
    first path column's node, the same in all its leaves), ``supply`` and
    ``cap`` in tokens. Below the first level a node weighs as much as its
    supply to the power ``temper``. A shortage is made up by siblings before
    the parent's siblings see it, as a parent is short only if all its
    children are. Returns the leaves with granted; null path values are a
    child of their own.
    """
    named = leaves
    for c in path:
        named = named.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    budget = named.groupBy(*roots).agg(F.max("budget").alias("budget"))
    parent: list[str] = []
    for level, c in enumerate(path):
        nodes = named.groupBy(*roots, *path[: level + 1]).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"), F.max("weight").alias("weight"))
        if level:
            nodes = nodes.withColumn("weight", F.pow("supply", F.lit(temper)))
        nodes = nodes.join(budget, [*roots, *parent])
        shared = share_out(nodes, [*roots, *parent], c)
        parent = path[: level + 1]
        budget = shared.select(*roots, *parent, F.col("granted").alias("budget"))
    return named.drop("budget").join(budget.withColumnRenamed("budget", "granted"), [*roots, *path])


def short_lanes(schedule: DataFrame, mixture: DataFrame) -> DataFrame:
    """The recorded schedule shared out over lanes: per run, stage and lane
    what is asked, what the tree of budgets grants of it and of what others
    are short of, and who is short: granted less than asked.

    Of each run, stage and lane (however spelt) the greatest revision counts;
    of equal revisions the later compiled. Lanes that the mixture lacks, and
    rows with a null run, stage, lane or revision, are left out.
    """
    values = F.struct("revision", "compiled_at", "tokens_available", "sequences_required", "distinct_samples_available", "repeat_factor")
    last = schedule.where(F.col("run_id").isNotNull() & F.col("revision").isNotNull()).groupBy("run_id", "stage", plain(F.col("lane")).alias("_lane")).agg(F.max(values).alias("r"))
    named = mixture.select("stage", "lane", plain(F.col("lane")).alias("_lane"), "sequence_length", "repeat_cap", "target_share")
    joined = lookup_join(last, named, ["stage", "_lane"], "inner")
    asked = F.col("r.sequences_required") * F.col("sequence_length")
    supply = F.col("r.tokens_available").cast("double")
    rows = joined.select(supply.alias("supply"), "run_id", "stage", "lane", "target_share", "repeat_cap", "r.sequences_required", "r.tokens_available", "r.repeat_factor", asked.alias("asked"), asked.cast("double").alias("weight"), (F.col("r.tokens_available") * F.col("repeat_cap")).alias("cap"))
    rows = rows.withColumn("budget", F.coalesce(F.sum("weight").over(Window.partitionBy("run_id", "stage")), F.lit(0.0)))
    # nobody gets less than was asked unless there isn't more; a thousandth is for the division
    return budget_tree(rows, ["run_id", "stage"], ["lane"]).withColumn("short", F.coalesce(F.col("asked") - F.col("granted") > 0.001, F.lit(False)))


def mix(counted: DataFrame, mixture: DataFrame, seed: int = 1, budget: float | None = None) -> DataFrame:
    """(stage, doc_id, lane, passes, tokens, served): how often each document
    is served, and how many tokens of it in all.

    counted: doc_id, lane, domain, lang, source, tokens. Each stage's budget
    (by default all tokens of its lanes once) goes to lanes by target_share,
    and on down domain, language and source; a lane is given no more than
    tokens x repeat_cap. A leaf gives its budget to the token: whole passes
    over its documents and a prefix of one more, in an order that seed, stage
    and pass determine, whose last document is cut where the prefix ends. So a
    leaf is never served more than its cap, though a document may stand in one
    pass more than the cap's whole part. The order is cut into buckets by
    ranges of a hash, so only the bucket in which the prefix ends is ordered
    exactly, and no leaf is too large. Documents without tokens, or of other
    lanes, aren't served.
    """
    shares = mixture.select("stage", "lane", "target_share", "repeat_cap")
    docs = counted.where(F.col("tokens") > 0).select("doc_id", "lane", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("domain", "lang", "source")], "tokens")
    path = ["lane", "domain", "lang", "source"]
    supply = docs.groupBy(*path).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("_rows"))
    leaves = lookup_join_many(supply, shares)
    total = F.lit(budget) if budget is not None else F.sum("supply").over(Window.partitionBy("stage"))
    leaves = leaves.withColumn("budget", total.cast("double")).withColumn("weight", F.col("target_share")).withColumn("cap", F.col("supply") * F.col("repeat_cap"))
    use_checkpoints(counted.sparkSession)
    given = budget_tree(leaves, ["stage"], path).select("stage", *path, "supply", "_rows", F.floor(F.col("granted") + 1e-6).alias("granted"))
    given = given.withColumn("whole", F.floor(F.col("granted") / F.col("supply")).cast("int"))
    given = given.withColumn("rest", F.col("granted") - F.col("whole") * F.col("supply")).withColumn("_buckets", F.ceil(F.col("_rows") / BUCKET_ROWS).cast("long"))
    # a row per leaf, and below per bucket: each is measured before it is joined
    given = given.checkpoint()
    served = _join_leaves(docs, given, path)
    order = F.xxhash64(F.lit(seed), "stage", "whole", "doc_id")
    # floor(order's place among all hashes x buckets): buckets follow the order
    place = F.shiftrightunsigned(order, 1).cast("double") / F.lit(float(1 << 63))
    served = served.withColumn("_order", F.shiftrightunsigned(order, 1)).withColumn("_bucket", F.least(F.floor(place * F.col("_buckets")), F.col("_buckets") - 1))
    sums = served.groupBy("stage", *path, "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("stage", *path).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).checkpoint()
    placed = _join_leaves(served, sums, ["stage", *path, "_bucket"])
    ends_inside = (F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest"))
    run = Window.partitionBy("stage", *path, "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("_before") + F.sum("tokens").over(run) - F.col("tokens")
    inside = placed.where(ends_inside).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - begins)))
    outside = placed.where(~ends_inside).withColumn("_more", F.when(F.col("_before") + F.col("_sum") <= F.col("rest"), F.col("tokens")).otherwise(0))
    both = inside.unionByName(outside).withColumn("passes", F.col("whole") + (F.col("_more") > 0).cast("int"))
    return both.where(F.col("passes") > 0).select("stage", "doc_id", "lane", "passes", "tokens", (F.col("whole") * F.col("tokens") + F.col("_more")).cast("long").alias("served"))


def lookup_join_many(supply: DataFrame, shares: DataFrame) -> DataFrame:
    """Leaves times the stages that have their lane: both sides are small."""
    return supply.join(shares, "lane")


def _join_leaves(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join documents to a per-leaf table, which is broadcast if its measured
    size allows; otherwise each leaf is spread over salted partitions."""
    if is_small(small):
        return rows.join(F.broadcast(small), on)
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*on, "_salt"]).drop("_salt")


def shares(served: DataFrame, counted: DataFrame, mixture: DataFrame) -> DataFrame:
    """Per stage and lane: target and actual share of tokens, and repeats."""
    got = served.groupBy("stage", "lane").agg(F.sum("served").alias("tokens"), F.max("passes").alias("most_passes"))
    have = counted.groupBy("lane").agg(F.sum("tokens").alias("available"))
    rows = mixture.select("stage", "lane", "target_share", "repeat_cap").join(got, ["stage", "lane"], "left").join(have, "lane", "left").na.fill(0, ["tokens", "available", "most_passes"])
    total = F.sum("tokens").over(Window.partitionBy("stage"))
    return rows.select(
        "stage",
        "lane",
        "target_share",
        F.round(F.try_divide(F.col("tokens"), total), 6).alias("share"),
        "tokens",
        "available",
        F.round(F.try_divide(F.col("tokens"), F.col("available")), 6).alias("repeats"),
        "repeat_cap",
        "most_passes",
    )
