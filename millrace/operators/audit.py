"""What the ledgers, checkpoints and decisions say of each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ledger
from millrace.operators.windows import running_sum

# What identifies a served record.
FINGERPRINT = ("global_step", "rank", "microbatch_id", "batch_id", "plan_hash", "packed_sample_ids", "token_span_ids", "tokens_hash", "loss_mask_hash")
#: The place of a microbatch.
KEY = ["branch_id", "global_step", "rank", "microbatch_id"]


def versions(landings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that were rolled back and served again: their first landings
    (what was discarded) and their last ones, with the fields that identify
    them. Torn landings and rows without a key are none; a repeated landing is
    no new version."""
    whole = landings.where(F.col("event_hash").isNotNull() & F.col("branch_id").isNotNull() & F.col("seq").isNotNull() & (F.col("type") == "consume_microbatch"))
    row, order = F.struct("event_hash", "payload"), F.struct("landed_at", "event_hash")
    both = whole.groupBy("branch_id", "seq").agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("z")).where(F.col("a.event_hash") != F.col("z.event_hash"))
    fields = lambda side: [F.get_json_object(F.col(f"{side}.payload"), f"$.{f}").alias(f) for f in FINGERPRINT]
    return both.select("branch_id", *fields("a")).distinct(), both.select("branch_id", *fields("z")).distinct()


def compared(discarded: DataFrame, served: DataFrame) -> DataFrame:
    """(branch_id, global_step, rank, microbatch_id, state): each discarded
    microbatch beside the one served in its place: ``same``, ``mismatch`` (some
    field of the fingerprint differs), ``missing`` (none was served) or
    ``extra`` (served in no one's place). A place that occurs in several
    versions is ``same`` if the same ones are on both sides."""
    one = lambda df, name: df.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in FINGERPRINT]))).alias(name))
    both = one(discarded, "_a").join(one(served, "_z"), KEY, "full_outer")
    state = F.when(F.col("_z").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_z"), "same").otherwise("mismatch")
    return both.select(*KEY, state.alias("state"))


def replayed(records: DataFrame, mb: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per (branch_id, step) three derivations of what was served: as recorded
    (one batch id and one plan in all records of the step), hashed again (each
    record's hash follows from its payload) and computed again (the decisions
    that served its samples exist, were accepted, and belong to the step)."""
    own = ledger.event_hash(F.col("seq"), F.col("prev_hash"), F.col("type"), F.col("payload"))
    hashed = records.where(F.col("type") == "consume_microbatch").select("branch_id", "seq", (F.col("event_hash") == own).alias("_hashed"))
    rows = mb.join(hashed, ["branch_id", "seq"])
    steps = rows.groupBy("branch_id", "step").agg(F.count(F.lit(1)).alias("records"), ((F.countDistinct("batch_id") == 1) & (F.countDistinct("plan_hash") == 1)).alias("recorded"), F.bool_and("_hashed").alias("rehashed"))
    last = decisions.where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(F.max_by(F.struct("branch_id", "step", "status"), "seq").alias("d"))
    served = mb.select("branch_id", "step", F.explode("opus_decision_id").alias("decision_id"))
    good = (F.col("d.branch_id") == F.col("branch_id")) & (F.col("d.step") == F.col("step")) & (F.col("d.status") == "accepted")
    derived = served.join(last, "decision_id", "left").groupBy("branch_id", "step").agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("foreign"))
    return steps.join(derived, ["branch_id", "step"], "left").select("branch_id", "step", "records", "recorded", "rehashed", (F.coalesce("foreign", F.lit(0)) == 0).alias("recomputed"))


def totals_at(mb: DataFrame, marks: DataFrame, values: list[str]) -> DataFrame:
    """marks (branch_id, seq and others) with the sums of ``values`` over the
    branch's microbatches up to each mark's seq. Marks and records are ordered
    together, over stretches of seq; no mark is joined to all records."""
    rows = mb.select("branch_id", "seq", *values, F.lit(None).cast("string").alias("_mark")).unionByName(marks.select("branch_id", "seq", *[F.lit(0).cast("long").alias(v) for v in values], F.col("mark").alias("_mark")))
    rows = rows.withColumn("_late", F.col("_mark").isNotNull())
    for v in values:
        rows = running_sum(rows, ["branch_id"], ["seq", "_late", "_mark"], v, f"to_{v}")
    return rows.where("_late").select("branch_id", "seq", F.col("_mark").alias("mark"), *[f"to_{v}" for v in values])


def claims_checked(mb: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(branch_id, mark, name, claimed, found): what each checkpoint says was
    consumed up to its offset beside what the ledger has up to there. Both
    sides are joined in full, so a claim without a count, or the other way
    round, has a null."""
    kept = checkpoints.where(F.col("branch_id").isNotNull() & F.col("checkpoint_id").isNotNull())
    claim = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("long").alias("claimed"))
    claims = kept.select("branch_id", F.col("checkpoint_id").alias("mark"), F.inline(F.array(claim("positions", "tokens_consumed"), claim("loss_tokens", "loss_bearing_tokens_consumed"))))
    marks = kept.select("branch_id", F.col("checkpoint_id").alias("mark"), F.col("ledger_offset.event_seq").alias("seq")).where(F.col("seq").isNotNull())
    sums = totals_at(mb, marks, ["total_positions", "loss_bearing_tokens"]).join(mb.select("branch_id").distinct(), "branch_id", "left_semi")
    find = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("found"))
    found = sums.select("branch_id", "mark", F.inline(F.array(find("positions", "to_total_positions"), find("loss_tokens", "to_loss_bearing_tokens"))))
    return claims.join(found, ["branch_id", "mark", "name"], "full_outer")


def provenance(mb: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (branch_id, mark, step) with the distinct shards served in the
    steps before each: shards by the step that served them first, summed up."""
    first = mb.select("branch_id", "step", F.explode("shard_ids").alias("shard_id")).groupBy("branch_id", "shard_id").agg(F.min("step").alias("seq"))
    fresh = first.groupBy("branch_id", F.col("seq")).agg(F.count(F.lit(1)).alias("shards"))
    # a mark at a step comes before what that step serves
    return totals_at(fresh, marks.select("branch_id", "mark", (F.col("step") - 1).cast("int").alias("seq")), ["shards"]).select("branch_id", "mark", (F.col("seq") + 1).alias("step"), F.col("to_shards").alias("shards"))


def milestones(records: DataFrame, learning: DataFrame) -> DataFrame:
    """Per branch the first record of each kind in order, and whether they
    stand in the order in which they must: opened, served, and in the learning
    ledger learnt, summed up."""
    a = records.groupBy("branch_id").agg(*[F.min(F.when(F.col("type").isin(*kinds), F.col("seq"))).alias(name) for name, kinds in (("opened", ("branch_opened", "branch_forked")), ("served", ("consume_microbatch",)))])
    b = learning.where(F.col("branch_id").isNotNull()).groupBy("branch_id").agg(*[F.min(F.when(F.col("type") == kind, F.col("seq"))).alias(name) for name, kind in (("learnt", "sample_learning"), ("summed", "step_summary"))])
    ordered = lambda x, y: F.coalesce(F.col(x) < F.col(y), F.lit(False))
    return a.join(b, "branch_id", "full_outer").select("branch_id", "opened", "served", "learnt", "summed", (ordered("opened", "served") & ordered("learnt", "summed")).alias("in_order"))


def worked_example(mb: DataFrame, decisions: DataFrame, samples: DataFrame) -> DataFrame:
    """Per branch the first served sample whose decision and learning record
    both exist, with what they say."""
    served = mb.select("branch_id", "seq", "step", F.posexplode(F.arrays_zip("packed_sample_ids", "opus_decision_id", "shard_ids")).alias("idx", "s"))
    served = served.select("branch_id", "seq", "step", "idx", F.col("s.packed_sample_ids").alias("sample_id"), F.col("s.opus_decision_id").alias("decision_id"), F.col("s.shard_ids").alias("shard_id"))
    decided = decisions.where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(F.max_by(F.struct("status", "reason"), "seq").alias("d"))
    learnt = samples.groupBy("branch_id", "step", "sample_id").agg(F.min_by("loss_delta", "seq").alias("loss_delta"))
    both = served.join(decided, "decision_id").join(learnt, ["branch_id", "step", "sample_id"])
    return both.groupBy("branch_id").agg(F.min(F.struct("seq", "idx", "sample_id", "decision_id", "shard_id", "d", "loss_delta")).alias("r")).select("branch_id", "r.seq", "r.idx", "r.sample_id", "r.decision_id", "r.shard_id", "r.d.status", "r.d.reason", F.round("r.loss_delta", 6).alias("loss_delta"))


def spike_candidates(spikes: DataFrame, decisions: DataFrame, most: int = 3, lookback: int = 2) -> DataFrame:
    """Of each branch the first ``most`` spikes, each with the decision that
    had the greatest gradient norm in the steps up to it; equal ones by id.
    A branch has few spikes, as they are rare by their definition."""
    first = spikes.withColumn("_k", F.row_number().over(Window.partitionBy("branch_id").orderBy("step"))).where(F.col("_k") <= most)
    near = first.select("branch_id", F.col("step").alias("spike_step"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("step") - lookback), F.col("step"))).alias("step"))
    norm = F.when(~F.isnan("gradient_norm"), F.col("gradient_norm"))
    hit = decisions.where(F.col("decision_id").isNotNull()).select("branch_id", "step", "decision_id", norm.alias("norm")).where(F.col("norm").isNotNull()).join(near, ["branch_id", "step"])
    top = hit.groupBy("branch_id", "spike_step").agg(F.max("norm").alias("norm"))
    return hit.join(top, ["branch_id", "spike_step", "norm"]).groupBy("branch_id", "spike_step", "norm").agg(F.min("decision_id").alias("decision_id")).select("branch_id", "spike_step", "decision_id", F.round("norm", 6).alias("gradient_norm"))


def check(rows: DataFrame, name: str, bad: Column) -> DataFrame:
    """One row: how many of the rows are bad."""
    return rows.agg(F.lit(name).alias("check"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("looked_at"))


def verdicts(checks: list[DataFrame]) -> DataFrame:
    """All checks; one that looked at nothing hasn't passed."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.withColumn("passed", (F.col("bad") == 0) & (F.col("looked_at") > 0))
