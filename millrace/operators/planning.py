"""Which candidates each step is offered, and how a batch is laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import lookup_join
from millrace.operators.windows import running_sum


def shuffle_index(samples: DataFrame, seed: str) -> DataFrame:
    """(lane, sample_id, place): an order of each lane's samples that the seed
    alone decides. Places are counted over stretches of the hash, so a lane
    that holds most samples is no single task's."""
    h = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "lane", "sample_id"), 256), 1, 12)
    rows = samples.select("lane", "sample_id").distinct().withColumn("_h", F.conv(h, 16, 10).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    out = running_sum(rows, ["lane"], ["_h", "sample_id"], "_one", "place", width=None)
    return out.select("lane", "sample_id", (F.col("place") - 1).alias("place"))


def cursors(pools: DataFrame, keys: list[str]) -> DataFrame:
    """Where each step begins in its lane's stream: pool sizes of all steps before."""
    out = running_sum(pools, keys, ["step"], "pool", "_to")
    return out.select(*keys, "step", "pool", (F.col("_to") - F.col("pool")).alias("cursor"))


def draws(cursor: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """The samples that each step is offered, going round its lane's stream
    again where it ends; pass counts the rounds."""
    size = index.groupBy("lane").agg(F.count(F.lit(1)).alias("_n"))
    each = lookup_join(cursor, size, ["lane"], "inner").where("pool > 0").select(*keys, "step", "_n", F.explode(F.sequence("cursor", F.col("cursor") + F.col("pool") - 1)).alias("_at"))
    return each.withColumn("place", F.col("_at") % F.col("_n")).withColumn("pass", F.floor(F.col("_at") / F.col("_n"))).join(index, ["lane", "place"]).select(*keys, "step", (F.col("_at")).alias("draw"), "sample_id", "pass")


def interleaved(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``pos``: rows of a group taken from its lanes in turn, lanes by
    name. A row's place follows from its number in its lane and from the sizes
    of the other lanes, so no group has to be ordered as a whole."""
    numbered = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), [*keys, "lane"], [order], "_one", "_no")
    sizes = rows.groupBy(*keys, "lane").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.collect_list(F.struct("lane", "n")).alias("_sizes"))
    before = F.aggregate("_sizes", F.lit(0).cast("long"), lambda acc, s: acc + F.least(s["n"], F.col("_no") - 1) + ((s["lane"] < F.col("lane")) & (s["n"] >= F.col("_no"))).cast("long"))
    return numbered.join(sizes, keys).withColumn("pos", before).drop("_one", "_no", "_sizes")


def geometry(pos: Column, world: int, size: int) -> list[Column]:
    """accum, rank and slot of a place in the batch."""
    return [F.floor(pos / (world * size)).alias("accum"), (F.floor(pos / size) % world).alias("rank"), (pos % size).alias("slot")]


def ordered_hash(rows: DataFrame, keys: list[str], number: str, value: str, width: int = 1000) -> DataFrame:
    """A hash of each group's values in order of a number: of the hashes of
    stretches of it, as a group can be large."""
    joined = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda s: s[v]), ",")
    cut = rows.where(F.col(value).isNotNull()).withColumn("_part", F.floor(F.col(number) / width))
    parts = cut.groupBy(*keys, "_part").agg(F.sha2(joined(number, value), 256).alias("_h"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*keys).agg(F.substring(F.sha2(joined("_part", "_h"), 256), 1, 16).alias("plan_hash"), F.sum("n").alias("n"))


def select(candidates: DataFrame, keys: list[str], protected: tuple[str, ...], content: str = "candidate_id") -> DataFrame:
    """Status and reason of every candidate of a group.

    candidates: keys (with lane), candidate_id, score, matches (of the stage),
    quota. The median score is the bar. Of candidates with equal ``content``
    the best stays, others are rejected. Those that match the stage and clear the bar are
    taken on merit up to the quota; what is missing is filled in order of
    score, matching ones first; of the rest, mismatches of lanes that aren't
    protected are rejected and all others deferred. Scores are ranked rounded
    to six places, equal ones by id; a null or NaN score ranks last and never
    clears the bar.
    """
    rows = candidates.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).withColumn("_s", F.round("score", 6))
    order = [F.desc_nulls_last("_s"), F.asc("candidate_id")]
    bar = rows.groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("bar"))
    first = Window.partitionBy(*keys, content).orderBy(F.desc_nulls_last("_s"), "candidate_id")
    one = rows.join(bar, keys).withColumn("_copy", F.row_number().over(first) > 1)
    kept = one.where(~F.col("_copy")).withColumn("_clear", F.col("matches") & F.coalesce(F.col("score") >= F.col("bar"), F.lit(False)))
    group = Window.partitionBy(*keys)
    merit = F.col("_clear") & (F.row_number().over(Window.partitionBy(*keys, "_clear").orderBy(*order)) <= F.col("quota"))
    kept = kept.withColumn("_merit", merit).withColumn("_left", F.col("quota") - F.sum(F.col("_merit").cast("int")).over(group))
    fill = F.row_number().over(Window.partitionBy(*keys, "_merit").orderBy(F.desc("matches"), *order))
    kept = kept.withColumn("_fill", ~F.col("_merit") & (fill <= F.col("_left")))
    safe = F.col("lane").isin(*protected)
    status = F.when(F.col("_merit") | F.col("_fill"), "accepted").when(~F.col("matches") & ~safe, "rejected").otherwise("deferred")
    reason = F.when(F.col("_merit"), "merit").when(F.col("_fill") & ~F.col("matches"), F.when(safe, "bias").otherwise("stage_mismatch_fill")).when(F.col("_fill"), F.when(safe, "below_threshold").otherwise("quota_fill")).when(~F.col("matches") & ~safe, "stage_mismatch").otherwise("below_threshold")
    done = kept.select(*keys, "candidate_id", "score", status.alias("status"), reason.alias("reason"))
    copies = one.where("_copy").select(*keys, "candidate_id", "score", F.lit("rejected").alias("status"), F.lit("duplicate").alias("reason"))
    return done.unionByName(copies)
