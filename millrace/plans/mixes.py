"""Queries over mixtures, plans, selection and the proxy."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ledger, mixture, planning
from millrace.sources import table, tables

STEPS, WARMUP, PER_STEP = 16, 4, 8
SEED = "millrace"


def mixture_blend(spark, folder):
    b = mixture.blend(table(spark, folder, "stage_mixture"), STEPS, WARMUP)
    return b.select("stage", "local", "lane", F.round("share", 9).alias("share"))


def apportion(spark, folder):
    m = table(spark, folder, "stage_mixture").withColumn("weight", F.col("target_share"))
    return mixture.apportion(m, ["stage"], PER_STEP).select("stage", "lane", "units")


def _lane_supply(spark, folder):
    return table(spark, folder, "documents").groupBy("lane").agg(F.count(F.lit(1)).alias("available"))


def enforce_floors(spark, folder):
    """The apportioned units of every stage, raised to the protected floors."""
    m = table(spark, folder, "stage_mixture").withColumn("weight", F.col("target_share"))
    units = mixture.apportion(m, ["stage"], PER_STEP).select("stage", "lane", "units", F.col("protected_floor").alias("floor"), F.col("units").alias("apportioned"))
    after = mixture.enforce_floors(units.join(_lane_supply(spark, folder), "lane", "left"), ["stage"], PER_STEP, len(mixture.PROTECTED))
    return after.select("stage", "lane", "apportioned", "required", "added", F.array_join("donors", ",").alias("donors"), "units")


def compile_schedule(spark, folder):
    return mixture.compile_schedule(table(spark, folder, "stage_mixture"), _lane_supply(spark, folder), PER_STEP, STEPS, WARMUP)


def _schedule(spark, folder):
    """Of each run, stage and lane the greatest revision, lanes by plain name."""
    key = F.regexp_replace(F.lower("lane"), r"[\- ]", "_")
    s = table(spark, folder, "mixture_schedule").where(F.col("run_id").isNotNull() & F.col("revision").isNotNull()).withColumn("lane_key", key)
    fields = ["revision", "compiled_at", "sequences_required", "distinct_samples_available", "tokens_available", "resolution", "repeat_factor"]
    last = s.groupBy("run_id", "stage", "lane_key").agg(F.max_by(F.struct(*fields), F.struct("revision", "compiled_at", "tokens_available")).alias("r"))
    return last.select("run_id", "stage", "lane_key", "r.*")


def scarcity(spark, folder):
    return mixture.scarcity(_schedule(spark, folder)).groupBy("lane_key", "resolution", "found").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("factor"), 6).alias("most"))


def intent_vs_compiled(spark, folder):
    """Shares asked for and shares of the compiled sequences, per run and stage."""
    total = _schedule(spark, folder)
    sums = total.groupBy("run_id", "stage").agg(F.sum("sequences_required").alias("all"))
    m = table(spark, folder, "stage_mixture").select("stage", F.col("lane").alias("lane_key"), "target_share")
    joined = total.join(sums, ["run_id", "stage"]).join(m, ["stage", "lane_key"], "left")
    share = F.try_divide(F.col("sequences_required"), F.col("all"))
    return joined.select("run_id", "stage", "lane_key", "target_share", F.round(share, 6).alias("share"), F.round(share - F.coalesce("target_share", F.lit(0.0)), 6).alias("delta"))


def _lane_shares(spark, folder):
    t = ledger.lane_tokens(ledger.microbatches(table(spark, folder, "consumption_ledger")), "stage")
    sums = t.groupBy("stage").agg(F.sum("tokens").alias("all"))
    return t.join(sums, "stage").select("stage", "lane", "tokens", (F.col("tokens") / F.col("all")).alias("share"))


def mixture_compliance(spark, folder, tolerance: float = 0.05):
    """Planned shares of every stage beside those the ledger shows."""
    m = table(spark, folder, "stage_mixture").select("stage", "lane", "target_share")
    joined = m.join(_lane_shares(spark, folder), ["stage", "lane"], "left")
    delta = F.coalesce("share", F.lit(0.0)) - F.col("target_share")
    return joined.select("stage", "lane", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("share", F.lit(0.0)), 5).alias("share"), F.round(delta, 5).alias("delta"), (F.abs(delta) <= tolerance).alias("within"))


def floor_checks(spark, folder):
    m = table(spark, folder, "stage_mixture").where(F.col("protected_floor").isNotNull() & ~F.isnan("protected_floor")).select("stage", "lane", "protected_floor")
    share = F.coalesce("share", F.lit(0.0))
    return m.join(_lane_shares(spark, folder), ["stage", "lane"], "left").select("stage", "lane", "protected_floor", F.round(share, 5).alias("share"), (share >= F.col("protected_floor") - 1e-9).alias("kept"))


def stage_of_step(spark, folder):
    """Stage and model phase of every step of a branch, and what it served."""
    mb = ledger.microbatches(table(spark, folder, "consumption_ledger"))
    steps = mb.groupBy("branch_id", "step").agg(F.max("stage").alias("stage"), F.sum("total_positions").alias("positions"))
    ends = steps.groupBy("branch_id").agg(F.max("step").alias("_last"))
    part = F.col("step") / (F.col("_last") + 1)
    phase = F.when(F.col("stage") == "long-finish", "anneal").when(part < 0.34, "early").when(part < 0.67, "mid").otherwise("late")
    return steps.join(ends, "branch_id").groupBy("stage", phase.alias("phase")).agg(F.count(F.lit(1)).alias("steps"), F.sum("positions").alias("positions"))


def lr_schedule(spark, folder, warmup: int = 4):
    """The learning rate's factor at each step: a linear rise, then a cosine
    down to a tenth."""
    steps = ledger.microbatches(table(spark, folder, "consumption_ledger")).select("step").distinct()
    total = (steps.agg(F.max("step").alias("n")).first()["n"] or 0) + 1
    done = F.least(F.lit(1.0), (F.col("step") - warmup) / max(1, total - warmup))
    rate = F.when(F.col("step") < warmup, (F.col("step") + 1) / warmup).otherwise(0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * done)))
    return steps.select("step", F.round(rate, 9).alias("factor"))


def supply_check(spark, folder):
    """Samples that lanes have as segments beside those the newest schedules claim."""
    have = table(spark, folder, "segments").where(F.col("lane").isNotNull()).groupBy(F.col("lane").alias("lane_key")).agg(F.countDistinct("sample_id").alias("samples"))
    claim = _schedule(spark, folder).groupBy("lane_key").agg(F.max("distinct_samples_available").alias("claimed"), F.count(F.lit(1)).alias("rows"))
    return have.join(claim, "lane_key", "full_outer")


def _samples(spark, folder):
    return table(spark, folder, "segments").where(F.col("lane").isNotNull() & F.col("sample_id").isNotNull()).select("lane", "sample_id")


def shuffle_index(spark, folder):
    return planning.shuffle_index(_samples(spark, folder), SEED)


def _pools(spark, folder):
    d = table(spark, folder, "opus_decisions").where(F.col("lane").isNotNull() & F.col("branch_id").isNotNull() & F.col("step").isNotNull())
    return d.groupBy("branch_id", "lane", "step").agg(F.countDistinct("decision_id").alias("pool"))


def plan_cursors(spark, folder):
    return planning.cursors(_pools(spark, folder), ["branch_id", "lane"])


def plan_candidates(spark, folder):
    return planning.draws(planning.cursors(_pools(spark, folder), ["branch_id", "lane"]), planning.shuffle_index(_samples(spark, folder), SEED), ["branch_id", "lane"])


def _accepted(spark, folder):
    d = table(spark, folder, "opus_decisions").where(F.col("decision_id").isNotNull())
    last = d.groupBy("decision_id").agg(F.max_by(F.struct("seq", "branch_id", "step", "lane", "candidate_id", "status"), "seq").alias("r")).select("decision_id", "r.*")
    return last.where((F.col("status") == "accepted") & F.col("lane").isNotNull() & F.col("branch_id").isNotNull() & F.col("step").isNotNull())


def batch_layout(spark, folder):
    rows = planning.interleaved(_accepted(spark, folder), ["branch_id", "step"], "seq")
    return rows.select("branch_id", "step", "lane", "decision_id", "pos", *planning.geometry(F.col("pos"), 2, 2))


def plan_hash(spark, folder):
    return planning.ordered_hash(_accepted(spark, folder), ["branch_id", "step"], "seq", "candidate_id")


def select_candidates(spark, folder):
    """The selection made again from the recorded scores: how its outcomes
    compare with the recorded ones."""
    d = table(spark, folder, "opus_decisions").where(F.col("decision_id").isNotNull())
    last = d.groupBy("decision_id").agg(F.max_by(F.struct("branch_id", "step", "lane", "opus_score", "status", "reason"), "seq").alias("r")).select(F.col("decision_id").alias("candidate_id"), "r.*")
    last = last.where(F.col("lane").isNotNull() & F.col("branch_id").isNotNull() & F.col("step").isNotNull())
    keys = ["branch_id", "step", "lane"]
    quota = last.groupBy(*keys).agg(F.count_if(F.col("status") == "accepted").alias("quota"))
    matches = ~F.coalesce(F.col("reason").isin("stage_mismatch", "stage_mismatch_fill", "bias"), F.lit(False))
    found = planning.select(last.join(quota, keys).select(*keys, "candidate_id", F.col("opus_score").alias("score"), matches.alias("matches"), "quota"), keys, mixture.PROTECTED)
    return found.groupBy(*keys, "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first"))


def topk_candidates(spark, folder):
    """The best score of every step and its decision, whatever the lane."""
    d = table(spark, folder, "opus_decisions").where(F.col("opus_score").isNotNull() & ~F.isnan("opus_score") & F.col("decision_id").isNotNull())
    best = d.groupBy("branch_id", "step").agg(F.max(F.struct((F.col("opus_score") + 0.0).alias("s"), (-F.col("seq")).alias("q"), "decision_id")).alias("r"))
    return best.select("branch_id", "step", F.col("r.s").alias("opus_score"), F.col("r.decision_id").alias("decision_id"))


def proxy_direction(spark, folder):
    """The mean vector of each label, scaled to length 1."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return means.join(norm, "label").select("label", "i", F.round(F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0), 6).alias("x"))


def proxy_score(spark, folder):
    """How well each vector lies in the direction of the mean of all."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # one number for each dimension
    mean = [r["m"] for r in e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    norm = sum(m * m for m in mean) ** 0.5
    direction = F.array(*map(F.lit, mean)) if mean else F.array().cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return e.select("vec_id", F.round(F.coalesce(F.try_divide(dot(F.col("v"), direction), F.sqrt(dot(F.col("v"), F.col("v"))) * F.lit(norm)), F.lit(0.0)), 6).alias("score"))


def unigram_loss(spark, folder):
    """Mean loss of each lane's words under the corpus's word frequencies."""
    from millrace.functions import text

    words = table(spark, folder, "documents").select("lane", F.explode(text.words()).alias("word")).groupBy("lane", "word").agg(F.count(F.lit(1)).alias("n"))
    known = words.groupBy("word").agg(F.sum("n").alias("all"))
    total = words.agg(F.sum("n").alias("total")).first()["total"]
    loss = -F.log(F.col("all") / F.lit(total))
    return words.join(known, "word").groupBy("lane").agg(F.sum("n").alias("words"), F.round(F.sum(F.col("n") * loss) / F.sum("n"), 6).alias("loss"))


_NORM = "replace(replace(lower(lane), '-', '_'), ' ', '_')"
_SCHED = f"""with sch as (select *, {_NORM} lane_key from mixture_schedule where run_id is not null and revision is not null
  qualify row_number() over (partition by run_id, stage, {_NORM} order by revision desc, compiled_at desc nulls last, tokens_available desc nulls last) = 1)
"""
_ORD = "(values ('ground-layer', 0), ('broad-middle', 1), ('long-finish', 2)) o(stage, k)"
_MB = """with cur as (select * from consumption_ledger where event_hash is not null and branch_id is not null and seq is not null qualify row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) = 1),
mb as (select branch_id, seq, cast(payload->>'global_step' as int) step, payload->>'curriculum_stage' stage, cast(payload->>'sequence_length' as bigint) len, cast(payload->>'total_positions' as bigint) total,
  from_json(payload->'mixture_lane', '["varchar"]') lanes from cur where type = 'consume_microbatch'),
lt as (select stage, lane, sum(len) tokens from (select stage, len, unnest(lanes) lane from mb) group by all), ls as (select stage, lane, tokens, tokens / sum(tokens) over (partition by stage) share from lt)
"""
_IDX = f"""with smp as (select distinct lane, sample_id from segments where lane is not null and sample_id is not null),
ix as (select lane, sample_id, row_number() over (partition by lane order by sha256('{SEED}|' || lane || '|' || sample_id)[1:12], sample_id) - 1 place from smp),
pool as (select branch_id, lane, step, count(distinct decision_id) pool from opus_decisions where lane is not null and branch_id is not null and step is not null group by all),
cur as (select branch_id, lane, step, pool, sum(pool) over (partition by branch_id, lane order by step) - pool "cursor" from pool)
"""
_LAST = "with last as (select * from opus_decisions where decision_id is not null qualify row_number() over (partition by decision_id order by seq desc) = 1)\n"
_ACC = _LAST + ", acc as (select * from last where status = 'accepted' and lane is not null and branch_id is not null and step is not null)\n"



def _floors_sql(keys: str) -> str:
    """CTEs that raise the units of ``f0`` (keys, lane, units, floor,
    available) to their floors; the last is ``f3``."""
    g, out = f"partition by {keys}", ""
    for k in (1, 2, 3):
        out += f""", a{k} as (select *, coalesce(turn = {k}, false) mine from f{k - 1}),
b{k} as (select *, greatest(0, coalesce(max(case when mine then required - units end) over ({g}), 0)) owed, bool_or(not mine and floor is null and units > 0) over ({g}) any_free from a{k}),
c{k} as (select *, not mine and case when any_free then floor is null and units > 0 else units - 1 >= least_units end gives from b{k}),
d{k} as (select *, case when gives then greatest(0, least(units, owed - coalesce(sum(case when gives then units end) over ({g} order by gives desc, units desc, lane rows between unbounded preceding and 1 preceding), 0))) else 0 end part,
  list_transform(list_sort(list(case when gives then (-units, lane) end) over ({g}))[1:3], lambda x: x[2]) asked from c{k}),
e{k} as (select *, case when mine then sum(part) over ({g}) else 0 end got from d{k}),
f{k} as (select * exclude (mine, owed, any_free, gives, part, asked, got, units, added, donors), added + got added, case when got > 0 then asked else donors end donors, units - part + got units from e{k})
"""
    return out


_FLOORED = f"""select *, greatest(0, coalesce(ceil(floor * {PER_STEP} - 1e-9), 0)) least_units, least(coalesce(ceil(floor * {PER_STEP} - 1e-9), 0), coalesce(available, 1e18)) required, 0 added, []::varchar[] donors"""

ORACLES = {
    "mixture_blend": f"""with m as (select s.stage, lane, target_share, k from stage_mixture s join {_ORD} on o.stage = s.stage), l as (select unnest(range(0, {STEPS}))::int "local")
select m.stage, l."local", m.lane, round((1 - least(1, (l."local" + 1) / {WARMUP})) * case when m.k = 0 then m.target_share else coalesce(p.target_share, 0) end + least(1, (l."local" + 1) / {WARMUP}) * m.target_share, 9) share
from m cross join l left join m p on p.k = m.k - 1 and p.lane = m.lane""",
    "apportion": f"""with e as (select stage, lane, {PER_STEP} * target_share::decimal(18,9) / sum(target_share::decimal(18,9)) over (partition by stage) x from stage_mixture), f as (select *, round(x, 9) y from e),
g as (select *, {PER_STEP} - sum(floor(y)) over (partition by stage) lft, row_number() over (partition by stage order by y - floor(y) desc, lane) r from f)
select stage, lane, (floor(y) + (r <= lft)::int)::bigint units from g""",
    "enforce_floors": f"""with sup as (select lane, count(*) available from documents group by 1),
e as (select stage, lane, protected_floor floor, {PER_STEP} * target_share::decimal(18,9) / sum(target_share::decimal(18,9)) over (partition by stage) x from stage_mixture), r as (select *, round(x, 9) y from e),
n as (select *, {PER_STEP} - sum(floor(y)) over (partition by stage) lft, row_number() over (partition by stage order by y - floor(y) desc, lane) r from r),
u as (select n.stage, n.lane, case when not isnan(n.floor) then n.floor end floor, (floor(y) + (r <= lft)::int)::bigint units, available from n left join sup using (lane)),
f0 as ({_FLOORED}, units apportioned, case when floor is not null then sum((floor is not null)::int) over (partition by stage order by lane) end turn from u){_floors_sql("stage")}
select stage, lane, apportioned::bigint apportioned, required::bigint required, added::bigint added, coalesce(array_to_string(donors, ','), '') donors, units::bigint units from f3""",
    "compile_schedule": f"""with sup as (select lane, count(*) available from documents group by 1),
m as (select s.stage, lane, target_share, protected_floor, k from stage_mixture s join {_ORD} on o.stage = s.stage), l as (select unnest(range(0, {STEPS}))::int "local"),
w as (select m.stage, l."local", m.lane, case when not isnan(m.protected_floor) then m.protected_floor end floor, coalesce(available, 0) available,
  case when available > 0 then (1 - least(1, (l."local" + 1) / {WARMUP})) * case when m.k = 0 then m.target_share else coalesce(p.target_share, 0) end + least(1, (l."local" + 1) / {WARMUP}) * m.target_share else 0 end weight
  from m cross join l left join m p on p.k = m.k - 1 and p.lane = m.lane left join sup on sup.lane = m.lane),
e as (select *, {PER_STEP} * weight::decimal(18,9) / nullif(sum(weight::decimal(18,9)) over (partition by stage, "local"), 0) x from w), r as (select *, coalesce(round(x, 9), 0) y from e),
n as (select *, {PER_STEP} - sum(floor(y)) over (partition by stage, "local") lft, row_number() over (partition by stage, "local" order by y - floor(y) desc, lane) r from r),
u as (select stage, "local", lane, floor, available, weight, (floor(y) + (r <= lft)::int)::bigint units from n),
f0 as ({_FLOORED}, case when floor is not null then sum((floor is not null)::int) over (partition by stage, "local" order by lane) end turn from u){_floors_sql('stage, "local"')},
s as (select *, case when available > 0 then units else 0 end have from f3), t as (select *, {PER_STEP} - sum(have) over (partition by stage, "local") miss, sum((available > 0)::int) over (partition by stage, "local") stocked,
  row_number() over (partition by stage, "local" order by available > 0 desc, weight desc, lane) - 1 pos from s)
select stage, "local", lane, (have + case when available > 0 and miss > 0 then miss // stocked + (pos < miss % stocked)::int else 0 end)::bigint sequences from t""",
    "scarcity": _SCHED + """, f as (select *, coalesce(sequences_required, 0) need, coalesce(distinct_samples_available, 0) have from sch),
g as (select *, case when have = 0 then 'impossible' when need = 0 or need <= have then 'satisfied' when lane_key in ('indic', 'agentic', 'reasoning') or need / have <= 2.5 then 'repeat' else 'synthesise' end found,
  round(case when need > 0 and have > 0 then greatest(1, need / have) when need > 0 then 0 else 1 end, 6) factor from f)
select lane_key, resolution, found, count(*) n, max(factor) most from g group by all""",
    "intent_vs_compiled": _SCHED + """, t as (select *, sequences_required / nullif(sum(sequences_required) over (partition by run_id, stage), 0) sh from sch)
select t.run_id, t.stage, t.lane_key, m.target_share, round(sh, 6) share, round(sh - coalesce(m.target_share, 0), 6) delta from t left join stage_mixture m on m.stage = t.stage and m.lane = t.lane_key""",
    "mixture_compliance": _MB + """select m.stage, m.lane, target_share, coalesce(tokens, 0) tokens, round(coalesce(share, 0), 5) share, round(coalesce(share, 0) - target_share, 5) delta, abs(coalesce(share, 0) - target_share) <= 0.05 "within"
from stage_mixture m left join ls using (stage, lane)""",
    "floor_checks": _MB + "select m.stage, m.lane, protected_floor, round(coalesce(share, 0), 5) share, coalesce(share, 0) >= protected_floor - 1e-9 kept from stage_mixture m left join ls using (stage, lane) where protected_floor is not null and not isnan(protected_floor)",
    "stage_of_step": _MB + """, s as (select branch_id, step, max(stage) stage, sum(total) positions from mb group by all), p as (select *, step / (max(step) over (partition by branch_id) + 1) f from s)
select stage, case when stage = 'long-finish' then 'anneal' when f < 0.34 then 'early' when f < 0.67 then 'mid' else 'late' end phase, count(*) steps, sum(positions) positions from p group by all""",
    "lr_schedule": _MB + """, s as (select distinct step from mb), t as (select max(step) + 1 total from s)
select step, round(case when step < 4 then (step + 1) / 4 else 0.1 + 0.45 * (1 + cos(3.141592653589793 * least(1.0, (step - 4) / greatest(1, total - 4)))) end, 9) factor from s, t""",
    "supply_check": _SCHED + """, h as (select lane lane_key, count(distinct sample_id) samples from segments where lane is not null group by 1), c as (select lane_key, max(distinct_samples_available) claimed, count(*) "rows" from sch group by 1)
select lane_key, samples, claimed, "rows" from h full join c using (lane_key)""",
    "shuffle_index": _IDX + "select lane, sample_id, place from ix",
    "plan_cursors": _IDX + 'select branch_id, lane, step, pool, "cursor" from cur',
    "plan_candidates": _IDX + """, n as (select lane, count(*) n from ix group by 1), d as (select branch_id, c.lane, step, n, unnest(range("cursor"::bigint, ("cursor" + pool)::bigint)) draw from cur c join n using (lane))
select branch_id, d.lane, step, draw, sample_id, draw // n pass from d join ix on ix.lane = d.lane and ix.place = d.draw % d.n""",
    "batch_layout": _ACC + """, r as (select *, row_number() over (partition by branch_id, step, lane order by seq) k from acc), p as (select *, row_number() over (partition by branch_id, step order by k, lane) - 1 pos from r)
select branch_id, step, lane, decision_id, pos, pos // 4 accum, (pos // 2) % 2 rank, pos % 2 slot from p""",
    "plan_hash": _ACC + """, s as (select branch_id, step, seq // 1000 part, sha256(string_agg(candidate_id, ',' order by seq)) h, count(*) n from acc where candidate_id is not null group by all)
select branch_id, step, sha256(string_agg(h, ',' order by part))[1:16] plan_hash, sum(n) n from s group by all""",
    "select_candidates": _LAST + """, q as (select decision_id id, branch_id, step, lane, case when isnan(opus_score) then null else opus_score end sc, coalesce(reason, '') not in ('stage_mismatch', 'stage_mismatch_fill', 'bias') mt,
  sum((status = 'accepted')::int) over (partition by branch_id, step, lane) quota, lane in ('indic', 'agentic', 'reasoning') safe from last where lane is not null and branch_id is not null and step is not null),
b as (select *, median(sc) over (partition by branch_id, step, lane) bar from q), c as (select *, mt and coalesce(sc >= bar, false) clr from b),
m as (select *, clr and row_number() over (partition by branch_id, step, lane, clr order by round(sc, 6) desc nulls last, id) <= quota merit from c),
l as (select *, quota - sum(merit::int) over (partition by branch_id, step, lane) lft, row_number() over (partition by branch_id, step, lane, merit order by mt desc, round(sc, 6) desc nulls last, id) fr from m),
f as (select *, not merit and fr <= lft fill from l)
select branch_id, step, lane, case when merit or fill then 'accepted' when not mt and not safe then 'rejected' else 'deferred' end status,
  case when merit then 'merit' when fill and not mt then case when safe then 'bias' else 'stage_mismatch_fill' end when fill then case when safe then 'below_threshold' else 'quota_fill' end when not mt and not safe then 'stage_mismatch' else 'below_threshold' end reason,
  count(*) n, min(id) "first" from f group by all""",
    "topk_candidates": """select branch_id, step, opus_score + 0.0 opus_score, decision_id from opus_decisions where opus_score is not null and not isnan(opus_score) and decision_id is not null
qualify row_number() over (partition by branch_id, step order by opus_score + 0.0 desc, seq) = 1""",
    "proxy_direction": """with e as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings), m as (select label, i, avg(x) m from e group by all)
select label, i, round(case when sum(m * m) over (partition by label) > 0 then m / sqrt(sum(m * m) over (partition by label)) else 0 end, 6) x from m""",
    "proxy_score": """with e as (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings), m as (select i, avg(x) m from e group by 1), s as (select sqrt(sum(m * m)) n from m)
select vec_id, round(coalesce(sum(x * m) / nullif(sqrt(sum(x * x)) * max(n), 0), 0), 6) score from e join m using (i), s group by 1""",
    "unigram_loss": r"""with w as (select lane, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\p{L}\p{N}_]+')) word from documents), c as (select lane, word, count(*) n from w group by all), k as (select word, sum(n) a from c group by 1), t as (select sum(a) total from k)
select lane, sum(n) words, round(sum(n * -ln(a / total)) / sum(n), 6) loss from c join k using (word), t group by 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
