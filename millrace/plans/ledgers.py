"""Queries over the consumption ledger, checkpoints and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ledger
from millrace.operators.windows import running_max
from millrace.sources import table

#: Microbatches of a step in this data: ranks times accumulation.
PER_STEP = 4


def _mb(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.microbatches(table(spark, folder, "consumption_ledger"))


def ledger_scan(spark, folder):
    return ledger.scan(table(spark, folder, "consumption_ledger")).groupBy("branch_id", "state").agg(F.count(F.lit(1)).alias("landings"))


def chain_verify(spark, folder):
    return ledger.chain_report(ledger.current(table(spark, folder, "consumption_ledger")))


def chain_breaks(spark, folder):
    return ledger.chain_breaks(ledger.current(table(spark, folder, "consumption_ledger")))


def ledger_integrity(spark, folder):
    return ledger.integrity(_mb(spark, folder), PER_STEP)


def ledger_gaps(spark, folder):
    return ledger.missing_steps(_mb(spark, folder))


def tokens_by_lane(spark, folder):
    return ledger.lane_tokens(_mb(spark, folder), "branch_id")


def tokens_by_stage_lane(spark, folder):
    return ledger.lane_tokens(_mb(spark, folder), "stage")


def efficiency(spark, folder):
    """Sums over all branches and the ratios of those sums."""
    sums = _mb(spark, folder).agg(F.count(F.lit(1)).alias("microbatches"), *[F.sum(c).alias(c) for c in ("total_positions", "loss_bearing_tokens", "context_only_tokens", "pad_tokens")])
    ratio = lambda c, name: F.round(F.try_divide(F.col(c), F.col("total_positions")), 6).alias(name)
    return sums.select("*", ratio("loss_bearing_tokens", "loss_density"), ratio("context_only_tokens", "context_share"), ratio("pad_tokens", "padding_waste"))


def all_branch_totals(spark, folder):
    """Consumption and learning of each branch, from both ledgers' union."""
    learning = table(spark, folder, "learning_ledger").groupBy("branch_id", "seq").agg(F.max(F.struct("landed_at", F.col("payload.loss_bearing_tokens").alias("n"), "type")).alias("r"))
    a = _mb(spark, folder).select("branch_id", F.lit("consumption").alias("ledger"), F.col("loss_bearing_tokens").alias("n"))
    b = learning.where(F.col("r.type") == "sample_learning").select("branch_id", F.lit("learning").alias("ledger"), F.col("r.n").cast("long").alias("n"))
    return a.unionByName(b).groupBy("branch_id", "ledger").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("loss_bearing_tokens"))


def _lineage(spark, folder) -> DataFrame:
    opened = ledger.current(table(spark, folder, "consumption_ledger")).where(F.col("type").isin("branch_opened", "branch_forked"))
    return opened.groupBy("branch_id").agg(F.max(F.get_json_object("payload", "$.parent_branch_id")).alias("parent"))


def lineage(spark, folder):
    """Every branch with each of its ancestors and their distance."""
    return ledger.ancestors(_lineage(spark, folder))


def shared_steps(spark, folder):
    """Steps that a fork and its parent both have."""
    steps = _mb(spark, folder).select("branch_id", "step").distinct()
    pairs = _lineage(spark, folder).where(F.col("parent").isNotNull())
    fork = steps.join(pairs, "branch_id")
    return fork.join(steps.select(F.col("branch_id").alias("parent"), "step"), ["parent", "step"], "left_semi").groupBy("branch_id", "parent").agg(F.count(F.lit(1)).alias("steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def fork_divergence(spark, folder):
    """Microbatches of a fork beside its parent's: equal batches, others, and
    how many there were to compare."""
    mb = _mb(spark, folder).select("branch_id", "step", "rank", "microbatch_id", "batch_id")
    pairs = _lineage(spark, folder).where(F.col("parent").isNotNull())
    key = ["parent", "step", "rank", "microbatch_id"]
    other = mb.select(F.col("branch_id").alias("parent"), "step", "rank", "microbatch_id", F.col("batch_id").alias("parent_batch")).dropDuplicates(key)
    joined = mb.dropDuplicates(["branch_id", "step", "rank", "microbatch_id"]).join(pairs, "branch_id").join(other, key)
    same = F.col("batch_id").eqNullSafe(F.col("parent_batch"))
    return joined.groupBy("branch_id", "parent").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("different"), F.min(F.when(~same, F.col("step"))).alias("first_difference"))


def _live(spark, folder) -> DataFrame:
    return table(spark, folder, "checkpoints").where(F.col("deleted_at").isNull() & F.col("branch_id").isNotNull())


def latest_checkpoint(spark, folder):
    """The newest checkpoint of each branch that is still there."""
    last = _live(spark, folder).groupBy("branch_id").agg(F.max(F.struct("global_step", "checkpoint_id")).alias("r"))
    return last.select("branch_id", "r.checkpoint_id", "r.global_step")


def checkpoint_retention(spark, folder):
    """Which checkpoints keeping the newest two of each branch would drop."""
    from pyspark.sql import Window

    order = Window.partitionBy("branch_id").orderBy(F.desc("global_step"), F.desc("checkpoint_id"))
    kept = _live(spark, folder).withColumn("k", F.row_number().over(order)).where("k <= 2").select("checkpoint_id")
    return _live(spark, folder).join(kept, "checkpoint_id", "left_anti").select("branch_id", "checkpoint_id")


def checkpoint_asof(spark, folder):
    """The checkpoint each step goes on from, and how many microbatches do."""
    saved = table(spark, folder, "checkpoints").where(F.col("branch_id").isNotNull() & F.col("global_step").isNotNull()).select("branch_id", F.col("global_step").alias("step"), F.col("global_step").alias("saved"), F.lit(None).cast("long").alias("microbatches")).distinct()
    steps = _mb(spark, folder).groupBy("branch_id", "step").agg(F.count(F.lit(1)).alias("microbatches")).withColumn("saved", F.lit(None).cast("int"))
    # a step sees a checkpoint saved at it: checkpoints come first
    both = saved.unionByName(steps).withColumn("late", F.col("microbatches").isNotNull())
    rows = running_max(both, ["branch_id"], ["step", "late"], "saved", "checkpoint_step").where("late")
    return rows.join(saved.select("branch_id").distinct(), "branch_id", "left_semi").select("branch_id", "step", "checkpoint_step", "microbatches")


def _offsets(spark, folder) -> DataFrame:
    o = table(spark, folder, "checkpoints").where(F.col("deleted_at").isNull())
    return o.select("branch_id", "checkpoint_id", "global_step", F.col("ledger_offset.event_seq").alias("event_seq"), F.col("ledger_offset.last_event_hash").alias("last_event_hash"), "next_expected_plan_hash")


def _last_offsets(spark, folder) -> DataFrame:
    rows = _offsets(spark, folder).where(F.col("branch_id").isNotNull())
    return rows.groupBy("branch_id").agg(F.max(F.struct("global_step", "checkpoint_id", "event_seq")).alias("r")).select("branch_id", "r.event_seq")


def rollback_split(spark, folder):
    return ledger.rollback(ledger.current(table(spark, folder, "consumption_ledger")), _last_offsets(spark, folder))


def rollback_guard(spark, folder):
    return ledger.rollback_guard(ledger.current(table(spark, folder, "consumption_ledger")), _offsets(spark, folder))


def rollback_compare(spark, folder):
    """Records that landed in more than one version (rolled back and served
    again): how many, and how many served other samples the second time."""
    whole = table(spark, folder, "consumption_ledger").where(F.col("event_hash").isNotNull() & (F.col("type") == "consume_microbatch"))
    f = lambda n: F.get_json_object("payload", f"$.{n}")
    fields = ["packed_sample_ids", "token_span_ids", "mixture_lane", "plan_hash"]
    rows = whole.select("branch_id", "seq", "event_hash", *[f(n).alias(n) for n in fields]).groupBy("branch_id", "seq").agg(F.countDistinct("event_hash").alias("versions"), *[F.countDistinct(n).alias(n) for n in fields])
    return rows.where("versions > 1").groupBy("branch_id").agg(F.count(F.lit(1)).alias("reserved"), *[F.count_if(F.col(n) > 1).alias(f"other_{n}") for n in fields])


def next_batch(spark, folder):
    """Whether the plan that follows each checkpoint is the one it expects."""
    plans = _mb(spark, folder).groupBy("branch_id", F.col("step").alias("global_step")).agg(F.min("plan_hash").alias("plan_hash"))
    joined = _offsets(spark, folder).where(F.col("branch_id").isNotNull()).join(plans, ["branch_id", "global_step"], "left")
    verdict = F.when(F.col("plan_hash").isNull(), "no_plan").when(F.col("plan_hash") == F.col("next_expected_plan_hash"), "same").otherwise("other")
    return joined.select("branch_id", "checkpoint_id", verdict.alias("verdict"))


def replay_interval(spark, folder, start: int = 6, end: int = 18):
    """Steps of an interval: one plan hash in all of a step's records, and a
    batch id that is the same wherever the step was served again."""
    mb = _mb(spark, folder).where(F.col("step").between(start, end - 1))
    steps = mb.groupBy("branch_id", "step").agg(F.countDistinct("plan_hash").alias("plans"), F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("records"))
    return steps.groupBy("branch_id").agg(F.count(F.lit(1)).alias("steps"), F.bool_and(F.col("plans") == 1).alias("one_plan"), F.bool_and(F.col("batches") == 1).alias("one_batch"), F.bool_and(F.col("records") == PER_STEP).alias("complete"))


def shards_between_steps(spark, folder, start: int = 6, end: int = 12):
    return ledger.shards_between(_mb(spark, folder), start, end)


def shards_between_tokens(spark, folder, start: int = 20_000, end: int = 60_000):
    """Steps that hold a window of consumed tokens, and their distinct shards."""
    mb = _mb(spark, folder)
    window = ledger.token_window_steps(mb, start, end)
    hit = mb.join(window, "branch_id").where(F.col("step").between(F.col("first_step"), F.col("last_step")))
    return hit.select("branch_id", "first_step", "last_step", F.explode("shard_ids").alias("s")).groupBy("branch_id", "first_step", "last_step").agg(F.countDistinct("s").alias("shards"))


def span_tokens(spark, folder):
    """Served tokens per shard, each span as often as it was served."""
    return ledger.spans(_mb(spark, folder)).groupBy("shard_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))


def hash_consistency(spark, folder):
    """Identity fields that should have one value per branch."""
    c = table(spark, folder, "checkpoints")
    return c.groupBy("branch_id").agg(*[F.countDistinct(n).alias(n) for n in ("tokenizer_hash", "schedule_hash", "index_hash", "config_hash", "format_version")])


MB = """
with cur as (select * from (select *, row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) k
    from consumption_ledger where event_hash is not null and branch_id is not null and seq is not null) where k = 1),
mb as (select branch_id, seq, payload, cast(payload->>'global_step' as int) step, cast(payload->>'rank' as int) rank, payload->>'microbatch_id' microbatch_id, payload->>'batch_id' batch_id,
    payload->>'plan_hash' plan_hash, payload->>'curriculum_stage' stage, cast(payload->>'sequence_length' as bigint) len, cast(payload->>'loss_bearing_tokens' as bigint) loss, cast(payload->>'context_only_tokens' as bigint) ctx,
    cast(payload->>'pad_tokens' as bigint) pad, cast(payload->>'total_positions' as bigint) total, from_json(payload->'mixture_lane', '["varchar"]') lanes, from_json(payload->'token_span_ids', '["varchar"]') spans,
    from_json(payload->'shard_ids', '["varchar"]') shards from cur where type = 'consume_microbatch')
"""
_LINKS = "pairs as (select branch_id, max(payload->>'parent_branch_id') parent from cur where type in ('branch_opened', 'branch_forked') group by 1)"
_CHAIN = MB + """, bad as (select c.branch_id, c.seq, case when c.event_hash <> sha256('{"payload":' || c.payload || ',"prev_hash":"' || c.prev_hash || '","seq":' || c.seq || ',"type":"' || c.type || '"}') then 'hash'
    when c.seq > 0 and p.event_hash is null then 'gap' when c.prev_hash <> case when c.seq = 0 then repeat('0', 64) else p.event_hash end then 'link' end problem
  from cur c left join cur p on p.branch_id = c.branch_id and p.seq = c.seq - 1)
"""

ORACLES = {
    "ledger_scan": "select branch_id, case when event_hash is null then 'torn' when not coalesce(json_valid(payload), false) then 'damaged' else 'whole' end state, count(*) landings from consumption_ledger group by all",
    "chain_breaks": _CHAIN + "select branch_id, seq, problem from bad where problem is not null",
    "chain_verify": _CHAIN + """select branch_id, count(*) records, count(*) filter (problem = 'hash') hash, count(*) filter (problem = 'link') link, count(*) filter (problem = 'gap') gap,
  min(seq) filter (problem is not null) first_break from bad group by 1""",
    "ledger_integrity": MB + f""", k as (select branch_id, step, rank, microbatch_id, count(*) n, sum(loss) loss, sum(pad) pad, sum(total) total from mb group by all),
s as (select branch_id, step, sum(n) records, count(*) d, count(*) filter (n > 1) dup, sum(loss) loss, sum(pad) pad, sum(total) total from k group by all)
select branch_id, sum(records) records, sum(d) distinct_microbatches, sum(dup) duplicates, min(step) first_step, max(step) last_step, max(step) - min(step) + 1 - count(*) missing_steps,
  count(*) filter (records <> {PER_STEP}) incomplete_steps, sum(loss) loss_bearing_tokens, sum(pad) pad_tokens, sum(total) total_positions,
  round((sum(total) - sum(pad)) / sum(total), 5) utilisation, round(sum(loss) / sum(total), 5) loss_density from s group by 1""",
    "ledger_gaps": MB + "select r.branch_id, cast(r.step as int) step from (select branch_id, unnest(range(min(step), max(step) + 1)) step from mb group by 1) r anti join mb on mb.branch_id = r.branch_id and mb.step = r.step",
    "tokens_by_lane": MB + "select branch_id, lane, count(*) sequences, sum(len) tokens from (select branch_id, len, unnest(lanes) lane from mb) group by all",
    "tokens_by_stage_lane": MB + "select stage, lane, count(*) sequences, sum(len) tokens from (select stage, len, unnest(lanes) lane from mb) group by all",
    "efficiency": MB + """select count(*) microbatches, sum(total) total_positions, sum(loss) loss_bearing_tokens, sum(ctx) context_only_tokens, sum(pad) pad_tokens,
  round(sum(loss) / sum(total), 6) loss_density, round(sum(ctx) / sum(total), 6) context_share, round(sum(pad) / sum(total), 6) padding_waste from mb""",
    "all_branch_totals": MB + """, lr as (select branch_id, seq, type, payload.loss_bearing_tokens n, row_number() over (partition by branch_id, seq order by landed_at desc nulls last) k from learning_ledger)
select branch_id, 'consumption' ledger, count(*) records, sum(loss) loss_bearing_tokens from mb group by 1
union all select branch_id, 'learning', count(*), sum(n) from lr where k = 1 and type = 'sample_learning' group by 1""",
    "lineage": MB.replace("with cur", "with recursive cur") + f""", {_LINKS}, up as (select branch_id, parent ancestor, 1 depth from pairs where parent is not null
  union all select u.branch_id, b.parent, u.depth + 1 from up u join pairs b on b.branch_id = u.ancestor where b.parent is not null)
select branch_id, ancestor, depth from up""",
    "shared_steps": MB + f""", {_LINKS} select p.branch_id, p.parent, count(*) steps, min(a.step) first_step, max(a.step) last_step from pairs p join (select distinct branch_id, step from mb) a on a.branch_id = p.branch_id
  join (select distinct branch_id, step from mb) b on b.branch_id = p.parent and b.step = a.step group by all""",
    "fork_divergence": MB + f""", {_LINKS}, one as (select branch_id, step, rank, microbatch_id, min(batch_id) batch_id from mb group by all)
select p.branch_id, p.parent, count(*) compared, count(*) filter (a.batch_id is distinct from b.batch_id) different, min(a.step) filter (a.batch_id is distinct from b.batch_id) first_difference
from pairs p join one a on a.branch_id = p.branch_id join one b on b.branch_id = p.parent and b.step = a.step and b.rank = a.rank and b.microbatch_id = a.microbatch_id group by all""",
    "latest_checkpoint": "select branch_id, checkpoint_id, global_step from checkpoints where deleted_at is null and branch_id is not null qualify row_number() over (partition by branch_id order by global_step desc, checkpoint_id desc) = 1",
    "checkpoint_retention": "select branch_id, checkpoint_id from checkpoints where deleted_at is null and branch_id is not null qualify row_number() over (partition by branch_id order by global_step desc, checkpoint_id desc) > 2",
    "checkpoint_asof": MB + """select m.branch_id, m.step, (select max(c.global_step) from checkpoints c where c.branch_id = m.branch_id and c.global_step <= m.step) checkpoint_step, m.n microbatches
from (select branch_id, step, count(*) n from mb group by all) m where m.branch_id in (select branch_id from checkpoints)""",
    "rollback_split": MB + """, o as (select branch_id, ledger_offset.event_seq event_seq from checkpoints where deleted_at is null and branch_id is not null qualify row_number() over (partition by branch_id order by global_step desc, checkpoint_id desc) = 1)
select c.branch_id, o.event_seq, count(*) filter (seq <= event_seq) kept, count(*) filter (seq > event_seq) dropped, min(seq) filter (seq > event_seq) first_dropped from cur c join o using (branch_id) group by all""",
    "rollback_guard": MB + """select k.branch_id, k.checkpoint_id, k.ledger_offset.event_seq event_seq, case when c.event_hash is null then 'missing' else 'hash' end problem
from checkpoints k left join cur c on c.branch_id = k.branch_id and c.seq = k.ledger_offset.event_seq where k.deleted_at is null and c.event_hash is distinct from k.ledger_offset.last_event_hash""",
    "rollback_compare": """with v as (select branch_id, seq, count(distinct event_hash) n, count(distinct payload->>'packed_sample_ids') a, count(distinct payload->>'token_span_ids') b, count(distinct payload->>'mixture_lane') c, count(distinct payload->>'plan_hash') d
  from consumption_ledger where event_hash is not null and type = 'consume_microbatch' group by all)
select branch_id, count(*) reserved, count(*) filter (a > 1) other_packed_sample_ids, count(*) filter (b > 1) other_token_span_ids, count(*) filter (c > 1) other_mixture_lane, count(*) filter (d > 1) other_plan_hash from v where n > 1 group by 1""",
    "next_batch": MB + """, p as (select branch_id, step, min(plan_hash) plan_hash from mb group by all)
select k.branch_id, k.checkpoint_id, case when p.plan_hash is null then 'no_plan' when p.plan_hash = k.next_expected_plan_hash then 'same' else 'other' end verdict
from checkpoints k left join p on p.branch_id = k.branch_id and p.step = k.global_step where k.deleted_at is null and k.branch_id is not null""",
    "replay_interval": MB + f""", s as (select branch_id, step, count(distinct plan_hash) plans, count(distinct batch_id) batches, count(*) n from mb where step >= 6 and step < 18 group by all)
select branch_id, count(*) steps, bool_and(plans = 1) one_plan, bool_and(batches = 1) one_batch, bool_and(n = {PER_STEP}) complete from s group by 1""",
    "shards_between_steps": MB + """, w as (select * from mb where step >= 6 and step < 12), sp as (select branch_id, step, unnest(spans) span from w),
sh as (select branch_id, split_part(span, ':', 1) shard_id, span, cast(split_part(split_part(span, ':', 2), '-', 2) as bigint) - cast(split_part(split_part(span, ':', 2), '-', 1) as bigint) n, step from sp
  union all select branch_id, unnest(shards), null, 0, step from w)
select branch_id, shard_id, count(distinct span) distinct_spans, sum(n) span_tokens, min(step) first_step, max(step) last_step from sh group by all""",
    "shards_between_tokens": MB + """, r as (select branch_id, step, total, sum(total) over (partition by branch_id order by step, seq) after from mb),
w as (select branch_id, min(step) a, max(step) b from r where after - total < 60000 and after > 20000 group by 1)
select branch_id, a first_step, b last_step, count(distinct s) shards from (select m.branch_id, w.a, w.b, unnest(m.shards) s from mb m join w on w.branch_id = m.branch_id and m.step between w.a and w.b) group by all""",
    "span_tokens": MB + """select split_part(span, ':', 1) shard_id, count(*) spans, sum(cast(split_part(split_part(span, ':', 2), '-', 2) as bigint) - cast(split_part(split_part(span, ':', 2), '-', 1) as bigint)) tokens
from (select unnest(spans) span from mb) group by 1""",
    "hash_consistency": """select branch_id, count(distinct tokenizer_hash) tokenizer_hash, count(distinct schedule_hash) schedule_hash, count(distinct index_hash) index_hash, count(distinct config_hash) config_hash,
  count(distinct format_version) format_version from checkpoints group by 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
