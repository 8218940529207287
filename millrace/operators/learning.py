"""What the model learnt from each shard, lane and phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import previous

# Thresholds of the classification.
LEARNED_OUT, SPIKE_RATIO, USEFUL, TAUGHT = 1.2, 8.0, 1e-4, 3.0


def samples(learning: DataFrame) -> DataFrame:
    """Current sample records, one per (branch_id, seq), with their fields."""
    rows = learning.where((F.col("type") == "sample_learning") & F.col("branch_id").isNotNull() & F.col("seq").isNotNull())
    last = rows.groupBy("branch_id", "seq").agg(F.max_by("payload", F.struct("landed_at", "event_hash")).alias("p"))
    fields = ["step", "sample_id", "lane", "curriculum_stage", "shard_ids", "doc_ids", "loss_before", "loss_after", "loss_delta", "gradient_norm", "loss_bearing_tokens", "mean_token_perplexity", "eos_perplexity", "model_phase", "checkpoint_before", "opus_decision_id", "opus_score", "repeated_pass_number"]
    return last.select("branch_id", "seq", *[F.col("p")[f].alias(f) for f in fields])


def perplexity(loss: str) -> Column:
    return F.exp(F.least(F.col(loss), F.lit(20.0)))


def _means() -> list[Column]:
    mean = lambda c: F.round(F.avg(c), 6)
    return [
        F.count(F.lit(1)).alias("exposures"),
        mean("loss_before").alias("mean_loss_before"),
        mean("loss_after").alias("mean_loss_after"),
        mean("loss_delta").alias("mean_loss_delta"),
        mean(F.when(F.col("mean_token_perplexity") > 0, F.col("mean_token_perplexity"))).alias("mean_perplexity"),
        mean("gradient_norm").alias("mean_gradient_norm"),
        F.sum("loss_bearing_tokens").alias("loss_bearing_tokens"),
    ]


def by_lane_phase(rows: DataFrame) -> DataFrame:
    """Means by lane, by phase and of all rows, from one pass over them."""
    sets = rows.groupingSets([["lane"], ["model_phase"], []], "lane", "model_phase")
    level = F.when(F.grouping("lane") == 0, "lane").when(F.grouping("model_phase") == 0, "phase").otherwise("all")
    out = sets.agg(level.alias("level"), *_means())
    return out.select("level", F.coalesce("lane", "model_phase").alias("name"), *[c for c in out.columns if c not in ("level", "lane", "model_phase")])


def report_cards(rows: DataFrame) -> DataFrame:
    """One row per shard: exposures, means, effect of repeats, class.

    The passes of a shard are reduced first, so a shard that most samples
    touch is a partial sum in every task.
    """
    each = rows.select(F.explode("shard_ids").alias("shard_id"), "loss_delta", "mean_token_perplexity", "gradient_norm", "opus_score", F.coalesce("repeated_pass_number", F.lit(0)).alias("pass"))
    positive = F.when(F.col("mean_token_perplexity") > 0, F.col("mean_token_perplexity"))
    sums = [(F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_n")) for n, c in (("delta", F.col("loss_delta")), ("ppl", positive), ("norm", F.col("gradient_norm")), ("score", F.col("opus_score")))]
    passes = each.groupBy("shard_id", "pass").agg(F.count(F.lit(1)).alias("n"), *[c for pair in sums for c in pair], F.max("gradient_norm").alias("top"))
    mean = lambda n: F.coalesce(F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_n")), F.lit(0.0))
    own = F.coalesce(F.try_divide(F.col("delta_sum"), F.col("delta_n")), F.lit(0.0))
    effect = F.when(F.count(F.lit(1)) > 1, F.max_by(own, "pass") - F.min_by(own, "pass")).otherwise(0.0)
    cards = passes.groupBy("shard_id").agg(
        F.sum("n").alias("exposures"),
        mean("delta").alias("_delta"),
        mean("ppl").alias("_ppl"),
        mean("norm").alias("_norm"),
        F.coalesce(F.max("top"), F.lit(0.0)).alias("_top"),
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("_score"),
        F.count(F.lit(1)).alias("passes"),
        effect.alias("_effect"),
    )
    spike = (F.col("_norm") > 0) & (F.col("_top") > SPIKE_RATIO * F.col("_norm")) & (F.col("_top") > 1.0)
    kind = (
        F.when((F.col("_ppl") > 0) & (F.col("_ppl") <= LEARNED_OUT), "exhausted")
        .when(spike, "harmful")
        .when(F.col("_delta") < -USEFUL, "useful")
        .when(F.col("_delta") > USEFUL, "harmful")
        .otherwise("neutral")
    )
    return cards.select(
        "shard_id",
        "exposures",
        F.round("_delta", 6).alias("mean_loss_delta"),
        F.round("_ppl", 6).alias("mean_perplexity"),
        F.round("_norm", 6).alias("mean_gradient_norm"),
        F.round("_top", 6).alias("max_gradient_norm"),
        F.round("_score", 9).alias("mean_score"),
        "passes",
        F.round("_effect", 6).alias("repeat_effect"),
        kind.alias("class"),
    )


def next_actions(cards: DataFrame) -> DataFrame:
    """What to do with each shard: a shard can be in several lists."""
    kind = F.col("class")
    picks = F.array(
        F.when(kind == "useful", "collect_more"),
        F.when((kind == "useful") & (F.col("mean_perplexity") > TAUGHT), "protect"),
        F.when(kind == "neutral", "defer"),
        F.when(kind.isin("exhausted", "harmful"), "reject"),
        F.when((F.col("repeat_effect") > 0) & (F.col("passes") > 1), "repeat"),
    )
    return cards.select("shard_id", "class", F.explode(F.array_compact(picks)).alias("action"))


def step_losses(rows: DataFrame) -> DataFrame:
    """Mean loss and gradient norm of every step of a branch."""
    return rows.where(F.col("loss_after").isNotNull() & F.col("step").isNotNull()).groupBy("branch_id", "step").agg(F.avg("loss_after").alias("loss"), F.max("gradient_norm").alias("gradient_norm"))


def loss_spikes(steps: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Steps whose loss rose by more than sigma standard deviations beyond the
    branch's mean change; of branches with four steps or more."""
    changed = previous(steps, ["branch_id"], "step", ["loss"]).withColumn("delta", F.col("loss") - F.col("prev_loss"))
    stats = changed.groupBy("branch_id").agg(F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("spread"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    spread = F.when(F.col("spread") == 0, 1e-9).otherwise(F.col("spread"))
    joined = changed.join(stats.withColumn("spread", spread), "branch_id")
    hot = joined.where(F.col("delta") > F.col("mean") + sigma * F.col("spread"))
    return hot.select("branch_id", "step", F.round("loss", 6).alias("loss"), F.round("delta", 6).alias("delta"), F.round((F.col("delta") - F.col("mean")) / F.col("spread"), 4).alias("z_score"))


def before_spikes(spikes: DataFrame, mb: DataFrame, lookback: int = 2) -> DataFrame:
    """Shards served in the steps up to each spike. The few steps that count
    are listed, which makes the range join an equality join."""
    near = spikes.select("branch_id", F.col("step").alias("spike_step"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("step") - lookback), F.col("step"))).alias("step"))
    hit = mb.select("branch_id", "step", "shard_ids", "loss_bearing_tokens").join(near, ["branch_id", "step"])
    sums = hit.groupBy("branch_id", "spike_step").agg(F.count(F.lit(1)).alias("microbatches"), F.sum("loss_bearing_tokens").alias("loss_bearing_tokens"))
    shards = hit.select("branch_id", "spike_step", F.explode("shard_ids").alias("s")).groupBy("branch_id", "spike_step").agg(F.countDistinct("s").alias("shards"))
    return sums.join(shards, ["branch_id", "spike_step"])
