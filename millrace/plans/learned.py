"""Queries over the learning ledger and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ledger, learning
from millrace.plans.ledgers import MB
from millrace.sources import table


def _samples(spark, folder):
    return learning.samples(table(spark, folder, "learning_ledger"))


def _mb(spark, folder):
    return ledger.microbatches(table(spark, folder, "consumption_ledger"))


def learning_by_lane_phase(spark, folder):
    return learning.by_lane_phase(_samples(spark, folder))


def eos_perplexity(spark, folder):
    return _samples(spark, folder).agg(F.count("eos_perplexity").alias("samples"), *[F.round(f("eos_perplexity"), 6).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])


def perplexity(spark, folder):
    """Mean over a lane's samples of the capped perplexity of their loss."""
    return _samples(spark, folder).groupBy("lane").agg(F.round(F.avg(learning.perplexity("loss_before")), 6).alias("before"), F.round(F.avg(learning.perplexity("loss_after")), 6).alias("after"))


def shard_report_cards(spark, folder):
    return learning.report_cards(_samples(spark, folder))


def repeat_effect(spark, folder):
    cards = learning.report_cards(_samples(spark, folder)).where("passes > 1")
    return cards.select("shard_id", "passes", "repeat_effect")


def corpus_actions(spark, folder):
    actions = learning.next_actions(learning.report_cards(_samples(spark, folder)))
    return actions.groupBy("action", "class").agg(F.count(F.lit(1)).alias("shards"), F.min("shard_id").alias("first_shard"))


def loss_spikes(spark, folder):
    return learning.loss_spikes(learning.step_losses(_samples(spark, folder)))


def batches_before_spike(spark, folder):
    return learning.before_spikes(learning.loss_spikes(learning.step_losses(_samples(spark, folder))), _mb(spark, folder))


def validation_losses(spark, folder):
    """Unweighted mean of the sample means, per branch and stage."""
    return _samples(spark, folder).groupBy("branch_id", "curriculum_stage").agg(F.round(F.avg("loss_after"), 6).alias("loss"), F.round(F.exp(F.least(F.avg("loss_after"), F.lit(20.0))), 4).alias("perplexity"))


def completion_walk(spark, folder):
    """Every served sample followed to its decision and its learning record:
    how many have none."""
    served = _mb(spark, folder).select("branch_id", "step", F.explode(F.arrays_zip("packed_sample_ids", "opus_decision_id")).alias("s"))
    served = served.select("branch_id", "step", F.col("s.packed_sample_ids").alias("sample_id"), F.col("s.opus_decision_id").alias("decision_id"))
    decided = table(spark, folder, "opus_decisions").select("decision_id", F.lit(1).alias("decided")).where(F.col("decision_id").isNotNull()).distinct()
    learnt = _samples(spark, folder).select("branch_id", "step", "sample_id", F.lit(1).alias("learnt")).distinct()
    joined = served.join(decided, "decision_id", "left").join(learnt, ["branch_id", "step", "sample_id"], "left")
    return joined.groupBy("branch_id").agg(F.count(F.lit(1)).alias("served"), F.count_if(F.col("decided").isNull()).alias("no_decision"), F.count_if(F.col("learnt").isNull()).alias("no_learning"))


def decision_report(spark, folder):
    """Decisions by lane and status with all subtotals; a decision scored
    again counts once, as it was scored last."""
    last = _last_decisions(spark, folder, "lane", "status")
    cube = last.cube("lane", "status").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("decisions"))
    return cube.select("level", "lane", "status", "decisions")


def _last_decisions(spark, folder, *fields):
    d = table(spark, folder, "opus_decisions").where(F.col("decision_id").isNotNull())
    return d.groupBy("decision_id").agg(F.max_by(F.struct(*fields), "seq").alias("r")).select("decision_id", "r.*")


def decision_reasons(spark, folder):
    last = _last_decisions(spark, folder, "status", "reason", "effective_token_estimate")
    return last.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("decisions"), F.sum("effective_token_estimate").alias("tokens"))


def rescoring_identity(spark, folder):
    """Decisions scored more than once, and how many got another outcome."""
    d = table(spark, folder, "opus_decisions").where(F.col("decision_id").isNotNull())
    score = F.when(F.isnan("opus_score"), None).otherwise(F.round("opus_score", 6))
    again = d.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(score).alias("scores"), F.countDistinct("status").alias("statuses"), F.max("branch_id").alias("branch_id")).where("n > 1")
    return again.groupBy("branch_id").agg(F.count(F.lit(1)).alias("rescored"), F.count_if(F.col("scores") > 1).alias("other_score"), F.count_if(F.col("statuses") > 1).alias("other_status"))


def proxy_health(spark, folder):
    """Mean score of a branch's last step against its first."""
    d = table(spark, folder, "opus_decisions").where(F.col("opus_score").isNotNull() & ~F.isnan("opus_score") & F.col("step").isNotNull())
    steps = d.groupBy("branch_id", "step").agg(F.avg("opus_score").alias("score"))
    ends = steps.groupBy("branch_id").agg(F.count(F.lit(1)).alias("steps"), F.min_by("score", "step").alias("first"), F.max_by("score", "step").alias("last"))
    ratio = F.try_divide(F.col("last"), F.col("first"))
    verdict = F.when(ratio < 0.35, "collapsed").when(ratio > 2.5, "inflated").when(ratio.isNull(), "unknown").otherwise("steady")
    return ends.select("branch_id", "steps", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


SAMPLES = """
with smp as (select branch_id, seq, payload.* from (select *, row_number() over (partition by branch_id, seq order by landed_at desc nulls last, event_hash desc nulls last) k from learning_ledger
    where type = 'sample_learning' and branch_id is not null and seq is not null) where k = 1)
"""
_MEANS = """count(*) exposures, round(avg(loss_before), 6) mean_loss_before, round(avg(loss_after), 6) mean_loss_after, round(avg(loss_delta), 6) mean_loss_delta,
  round(avg(mean_token_perplexity) filter (mean_token_perplexity > 0), 6) mean_perplexity, round(avg(gradient_norm), 6) mean_gradient_norm, sum(loss_bearing_tokens) loss_bearing_tokens"""
_CARDS = SAMPLES + """, e as (select unnest(shard_ids) shard_id, loss_delta d, case when mean_token_perplexity > 0 then mean_token_perplexity end p, gradient_norm g, opus_score s, coalesce(repeated_pass_number, 0) ps from smp),
pas as (select shard_id, ps, coalesce(avg(d), 0) m from e group by all),
eff as (select shard_id, count(*) passes, case when count(*) > 1 then arg_max(m, ps) - arg_min(m, ps) else 0 end effect from pas group by 1),
c as (select shard_id, count(*) exposures, coalesce(avg(d), 0) d, coalesce(avg(p), 0) p, coalesce(avg(g), 0) g, coalesce(max(g), 0) top, avg(s) s from e group by 1),
cards as (select c.shard_id, exposures, round(d, 6) mean_loss_delta, round(p, 6) mean_perplexity, round(g, 6) mean_gradient_norm, round(top, 6) max_gradient_norm, round(s, 9) mean_score, passes, round(effect, 6) repeat_effect,
  case when p > 0 and p <= 1.2 then 'exhausted' when g > 0 and top > 8 * g and top > 1 then 'harmful' when d < -1e-4 then 'useful' when d > 1e-4 then 'harmful' else 'neutral' end class from c join eff using (shard_id))
"""
_SPIKES = SAMPLES + """, st as (select branch_id, step, avg(loss_after) loss from smp where loss_after is not null and step is not null group by all),
ch as (select *, loss - lag(loss) over (partition by branch_id order by step) delta from st),
sp as (select *, avg(delta) over w m, case when stddev_pop(delta) over w = 0 then 1e-9 else stddev_pop(delta) over w end sd, count(*) over w n from ch window w as (partition by branch_id)),
spikes as (select branch_id, step, loss, delta, (delta - m) / sd z from sp where n >= 4 and delta > m + 1.5 * sd)
"""
_WALK = MB + ", " + SAMPLES.strip().removeprefix("with") + """, srv as (select branch_id, step, unnest(from_json(payload->'packed_sample_ids', '["varchar"]')) sample_id, unnest(from_json(payload->'opus_decision_id', '["varchar"]')) decision_id from mb),
walk as (select s.branch_id, count(*) served, count(*) filter (s.decision_id is null or s.decision_id not in (select decision_id from opus_decisions where decision_id is not null)) no_decision,
  count(*) filter (l.sample_id is null) no_learning from srv s left join (select distinct branch_id, step, sample_id from smp) l using (branch_id, step, sample_id) group by 1)
"""
_LAST = "with last as (select * from opus_decisions where decision_id is not null qualify row_number() over (partition by decision_id order by seq desc) = 1)\n"

ORACLES = {
    "learning_by_lane_phase": SAMPLES + f"""select 'lane' level, lane as name, {_MEANS} from smp group by lane union all select 'phase', model_phase, {_MEANS} from smp group by model_phase union all select 'all', null, {_MEANS} from smp""",
    "eos_perplexity": SAMPLES + "select count(eos_perplexity) samples, round(avg(eos_perplexity), 6) mean, round(min(eos_perplexity), 6) least, round(max(eos_perplexity), 6) most from smp",
    "perplexity": SAMPLES + "select lane, round(avg(exp(least(loss_before, 20))), 6) \"before\", round(avg(exp(least(loss_after, 20))), 6) \"after\" from smp group by 1",
    "shard_report_cards": _CARDS + "select * from cards",
    "repeat_effect": _CARDS + "select shard_id, passes, repeat_effect from cards where passes > 1",
    "corpus_actions": _CARDS + """, a as (select shard_id, class, unnest(list_filter([case when class = 'useful' then 'collect_more' end, case when class = 'useful' and mean_perplexity > 3 then 'protect' end, case when class = 'neutral' then 'defer' end,
  case when class in ('exhausted', 'harmful') then 'reject' end, case when repeat_effect > 0 and passes > 1 then 'repeat' end], lambda x: x is not null)) action from cards)
select action, class, count(*) shards, min(shard_id) first_shard from a group by all""",
    "loss_spikes": _SPIKES + "select branch_id, step, round(loss, 6) loss, round(delta, 6) delta, round(z, 4) z_score from spikes",
    "batches_before_spike": MB + ", " + _SPIKES.strip().removeprefix("with") + """, hit as (select s.branch_id, s.step spike_step, m.shards, m.loss from spikes s join mb m on m.branch_id = s.branch_id and m.step between greatest(0, s.step - 2) and s.step),
sh as (select branch_id, spike_step, count(distinct x) shards from (select branch_id, spike_step, unnest(shards) x from hit) group by all)
select h.branch_id, h.spike_step, count(*) microbatches, sum(h.loss) loss_bearing_tokens, max(sh.shards) shards from hit h join sh using (branch_id, spike_step) group by all""",
    "validation_losses": SAMPLES + "select branch_id, curriculum_stage, round(avg(loss_after), 6) loss, round(exp(least(avg(loss_after), 20)), 4) perplexity from smp group by all",
    "completion_walk": _WALK + "select * from walk",
    "decision_report": _LAST + "select grouping(lane, status) level, lane, status, count(*) decisions from last group by cube (lane, status)",
    "decision_reasons": _LAST + "select status, reason, count(*) decisions, sum(effective_token_estimate) tokens from last group by all",
    "rescoring_identity": """with d as (select decision_id, max(branch_id) branch_id, count(distinct case when isnan(opus_score) then null else round(opus_score, 6) end) s, count(distinct status) t from opus_decisions where decision_id is not null group by 1 having count(*) > 1)
select branch_id, count(*) rescored, count(*) filter (s > 1) other_score, count(*) filter (t > 1) other_status from d group by 1""",
    "proxy_health": """with s as (select branch_id, step, avg(opus_score) m from opus_decisions where opus_score is not null and not isnan(opus_score) and step is not null group by all),
e as (select branch_id, count(*) steps, case when arg_min(m, step) <> 0 then arg_max(m, step) / arg_min(m, step) end r from s group by 1)
select branch_id, steps, round(r, 6) ratio, case when r < 0.35 then 'collapsed' when r > 2.5 then 'inflated' when r is null then 'unknown' else 'steady' end verdict from e""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
