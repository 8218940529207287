"""Queries that set ledgers, checkpoints, decisions and learning against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import audit, ledger, learning
from millrace.plans import learned, mixes
from millrace.plans.ledgers import MB
from millrace.sources import table


def _landings(spark, folder):
    return table(spark, folder, "consumption_ledger")


def _mb(spark, folder):
    return ledger.microbatches(_landings(spark, folder))


def _decisions(spark, folder):
    return table(spark, folder, "opus_decisions")


def _samples(spark, folder):
    return learning.samples(table(spark, folder, "learning_ledger"))


def _compared(spark, folder):
    return audit.compared(*audit.versions(_landings(spark, folder)))


def reserved_compare(spark, folder):
    """Discarded microbatches beside those served again in their place."""
    return _compared(spark, folder).groupBy("branch_id", "state").agg(F.count(F.lit(1)).alias("microbatches"), F.min(F.col("global_step").cast("int")).alias("first_step"))


def _replayed(spark, folder):
    return audit.replayed(ledger.current(_landings(spark, folder)), _mb(spark, folder), _decisions(spark, folder))


def replay_derivations(spark, folder):
    """Steps of each branch for which the three derivations of a replay hold."""
    every = F.col("recorded") & F.col("rehashed") & F.col("recomputed")
    return _replayed(spark, folder).groupBy("branch_id").agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col(c)).alias(c) for c in ("recorded", "rehashed", "recomputed")], F.bool_and(every).alias("all_match"))


def evidence_verify(spark, folder):
    """Claims of the checkpoints beside what the ledger has, by outcome."""
    rows = audit.claims_checked(_mb(spark, folder), table(spark, folder, "checkpoints"))
    state = F.when(F.col("found").isNull(), "unfounded").when(F.col("claimed").isNull(), "unclaimed").when(F.col("claimed") == F.col("found"), "same").otherwise("other")
    return rows.groupBy("branch_id", "name", state.alias("state")).agg(F.count(F.lit(1)).alias("claims"), F.sum("claimed").alias("claimed"), F.sum("found").alias("found"))


def checkpoint_provenance(spark, folder):
    """Distinct shards that each checkpoint's model has seen, from step 0 on."""
    marks = table(spark, folder, "checkpoints").where(F.col("branch_id").isNotNull() & F.col("global_step").isNotNull() & F.col("checkpoint_id").isNotNull()).select("branch_id", F.col("checkpoint_id").alias("mark"), F.col("global_step").alias("step"))
    return audit.provenance(_mb(spark, folder), marks).select("branch_id", F.col("mark").alias("checkpoint_id"), "step", "shards")


def milestone_order(spark, folder):
    return audit.milestones(ledger.current(_landings(spark, folder)), table(spark, folder, "learning_ledger"))


def worked_example(spark, folder):
    return audit.worked_example(_mb(spark, folder), _decisions(spark, folder), _samples(spark, folder))


def _spikes(spark, folder):
    return learning.loss_spikes(learning.step_losses(_samples(spark, folder)))


def spike_candidates(spark, folder):
    return audit.spike_candidates(_spikes(spark, folder), _decisions(spark, folder))


def audit_bundle(spark, folder, start: int = 6, end: int = 12):
    """Per branch in one table: shards seen in all, records of an interval,
    steps that hold the middle third of its tokens, and its first spikes."""
    mb = _mb(spark, folder)
    number = lambda part, c: (F.lit(part).alias("part"), c.cast("long").alias("value"))
    seen = mb.select("branch_id", F.explode("shard_ids").alias("s")).groupBy("branch_id").agg(F.countDistinct("s").alias("n")).select("branch_id", *number("shards", F.col("n")))
    interval = mb.where(F.col("step").between(start, end - 1)).groupBy("branch_id").agg(F.count(F.lit(1)).alias("n")).select("branch_id", *number("interval_records", F.col("n")))
    steps = audit.running_sum(mb.groupBy("branch_id", "step").agg(F.sum("total_positions").alias("n")), ["branch_id"], ["step"], "n", "to")
    total = mb.groupBy("branch_id").agg(F.sum("total_positions").alias("all"))
    third = steps.join(total, "branch_id").where((F.col("to") - F.col("n") < F.col("all") * 2 / 3) & (F.col("to") > F.col("all") / 3)).groupBy("branch_id").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    spikes = audit.spike_candidates(_spikes(spark, folder), _decisions(spark, folder)).select("branch_id", *number("spike_step", F.col("spike_step")))
    parts = [seen, interval, third.select("branch_id", *number("middle_first", F.col("a"))), third.select("branch_id", *number("middle_last", F.col("b"))), spikes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chain_append(spark, folder):
    """A note of what is thrown away, appended to every ledger: the records
    that go on from the ledgers' heads."""
    rows = ledger.current(_landings(spark, folder))
    note = rows.groupBy("branch_id").agg(F.max("seq").alias("seq")).select("branch_id", F.lit(0).alias("place"), F.lit("rollback").alias("type"), F.concat(F.lit('{"upto":'), F.col("seq").cast("string"), F.lit("}")).alias("payload"))
    return ledger.chained(note, ledger.heads(rows))


def batch_by_step(spark, folder):
    """The batch id of each step; of several the one written last."""
    return _mb(spark, folder).groupBy("branch_id", "step").agg(F.max_by("batch_id", "seq").alias("batch_id"))


def learning_view(spark, folder):
    """Learning records rebuilt with a value of its type for each field that
    is missing."""
    p = _samples(spark, folder)
    texts, numbers, whole = ("sample_id", "lane", "curriculum_stage", "model_phase", "checkpoint_before", "opus_decision_id"), ("loss_before", "loss_after", "loss_delta", "gradient_norm"), ("loss_bearing_tokens", "repeated_pass_number")
    return p.select("branch_id", "seq", F.coalesce("step", F.lit(-1)).alias("step"), *[F.coalesce(c, F.lit("")).alias(c) for c in texts], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers], *[F.coalesce(c, F.lit(0)).alias(c) for c in whole], F.coalesce(F.size("shard_ids"), F.lit(0)).alias("shards"))


def checkpoint_state_hash(spark, folder):
    """A hash of what each checkpoint says of its state."""
    fields = ["checkpoint_id", "run_id", "branch_id", "global_step", "stage", "ledger_offset.event_seq", "ledger_offset.last_event_hash", "rng_fingerprint", "tokenizer_hash", "schedule_hash", "config_hash", "parent_checkpoint_id", "tokens_consumed", "next_expected_plan_hash"]
    line = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields])
    return table(spark, folder, "checkpoints").select("checkpoint_id", F.substring(F.sha2(line, 256), 1, 16).alias("state_hash"))


def validation_reads(spark, folder):
    """Served samples of held-out lanes per branch: reads, and those that bore a gradient."""
    rows = _mb(spark, folder).select("branch_id", "loss_bearing_tokens", F.explode("mixture_lane").alias("lane"))
    held = F.col("lane").isin("validation", "test")
    return rows.groupBy("branch_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(held).alias("held_out_reads"), F.count_if(held & (F.col("loss_bearing_tokens") > 0)).alias("gradient_reads"))


def phase_timers(spark, folder):
    """Seconds of the ledger reader's runs by status and kind: running, and
    how far behind the landings it was when it started."""
    r = table(spark, folder, "ingest_runs")
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    timers = F.create_map(F.lit("run"), seconds("finished_at", "started_at"), F.lit("behind"), seconds("started_at", "read_upto"))
    each = r.select(F.coalesce("status", F.lit("none")).alias("status"), F.explode(timers).alias("timer", "s"))
    return each.groupBy("status", "timer").agg(F.count("s").alias("runs"), F.round(F.sum("s"), 3).alias("seconds"))


def evidence(spark, folder):
    """Thirteen checks, each over all it concerns; one that found nothing to
    look at hasn't passed."""
    mb, landings, decisions = _mb(spark, folder), _landings(spark, folder), _decisions(spark, folder)
    checkpoints = table(spark, folder, "checkpoints")
    last = decisions.where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(F.max_by(F.struct("status", "reason"), "seq").alias("d"))
    hashes = mb.select(F.explode(F.arrays_zip("packed_sample_ids", "tokens_hash")).alias("s")).groupBy(F.col("s.packed_sample_ids").alias("sample_id")).agg(F.countDistinct("s.tokens_hash").alias("n"))
    lanes = mb.select(F.explode("mixture_lane").alias("lane"), "loss_bearing_tokens")
    opened = ledger.current(landings).where(F.col("type") == "branch_forked").select(F.get_json_object("payload", "$.parent_branch_id").alias("parent"))
    forks = opened.join(mb.select(F.col("branch_id").alias("parent")).distinct().withColumn("_there", F.lit(True)), "parent", "left")
    claims = audit.claims_checked(mb, checkpoints).where(F.col("claimed").isNotNull())
    served = mb.select("branch_id", "step", F.explode(F.arrays_zip("packed_sample_ids", "opus_decision_id")).alias("s")).select("branch_id", "step", F.col("s.packed_sample_ids").alias("sample_id"), F.col("s.opus_decision_id").alias("decision_id"))
    learnt = _samples(spark, folder).select("branch_id", "step", "sample_id").distinct().withColumn("_learnt", F.lit(True))
    walk = served.join(last, "decision_id", "left").join(learnt, ["branch_id", "step", "sample_id"], "left")
    floors = mixes.floor_checks(spark, folder)
    trace = _samples(spark, folder)
    parts = F.col("loss_bearing_tokens") + F.col("context_only_tokens") + F.col("pad_tokens") != F.col("total_positions")
    return audit.verdicts([
        audit.check(audit.milestones(ledger.current(landings), table(spark, folder, "learning_ledger")), "end_to_end", ~F.col("in_order")),
        audit.check(hashes, "shard_immutability", F.col("n") > 1),
        audit.check(checkpoints.groupBy("branch_id").agg(F.countDistinct("tokenizer_hash").alias("n")), "tokenizer", F.col("n") != 1),
        audit.check(mb, "packing", F.coalesce(parts, F.lit(True)) | (F.col("total_positions") != F.col("sequence_length") * F.size("packed_sample_ids"))),
        audit.check(floors, "mixture", ~F.col("kept")),
        audit.check(last, "selection", F.col("d.status").isNull() | F.col("d.reason").isNull()),
        audit.check(lanes, "firewall", F.col("lane").isin("validation", "test") & (F.col("loss_bearing_tokens") > 0)),
        audit.check(_compared(spark, folder), "crash_recovery", F.col("state") != "same"),
        audit.check(_replayed(spark, folder), "replay", ~(F.col("recorded") & F.col("rehashed") & F.col("recomputed"))),
        audit.check(forks, "fork", F.col("_there").isNull()),
        audit.check(trace, "learning_trace", F.col("shard_ids").isNull() | F.col("doc_ids").isNull() | F.col("loss_before").isNull() | F.col("loss_after").isNull()),
        audit.check(claims, "throughput", ~F.coalesce(F.col("claimed") == F.col("found"), F.lit(False))),
        audit.check(walk, "completion", F.col("d").isNull() | F.col("_learnt").isNull()),
    ])


def completion_cards(spark, folder):
    """The last leg of the walk from served samples: shards served beside
    shards that have a report card, per branch."""
    served = _mb(spark, folder).select("branch_id", F.explode("shard_ids").alias("shard_id")).groupBy("branch_id", "shard_id").agg(F.count(F.lit(1)).alias("times"))
    cards = learning.report_cards(_samples(spark, folder)).select("shard_id", "class")
    both = served.join(cards, "shard_id", "left")
    return both.groupBy("branch_id", F.coalesce("class", F.lit("no_card")).alias("class")).agg(F.count(F.lit(1)).alias("shards"), F.sum("times").alias("times"))


def decision_rates(spark, folder):
    """Per branch how many decisions were accepted, how many overrode for a
    protected lane, and whether the three statuses are all there are."""
    last = _decisions(spark, folder).where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(F.max_by(F.struct("branch_id", "status", "protected_floor_override"), "seq").alias("r")).select("r.*")
    named = F.count_if(F.col("status").isin("accepted", "rejected", "deferred"))
    return last.groupBy("branch_id").agg(F.count(F.lit(1)).alias("decisions"), F.round(F.count_if(F.col("status") == "accepted") / F.count(F.lit(1)), 6).alias("acceptance"), F.count_if(F.coalesce("protected_floor_override", F.lit(False))).alias("overrides"), (named == F.count(F.lit(1))).alias("reconciled"))


def throughput(spark, folder):
    """Positions and graded tokens that each branch served, and those a second
    of the time over which its current records landed."""
    at = ledger.current(_landings(spark, folder)).select("branch_id", "seq", "landed_at")
    sums = _mb(spark, folder).join(at, ["branch_id", "seq"]).groupBy("branch_id").agg(F.sum("total_positions").alias("positions"), F.sum("loss_bearing_tokens").alias("graded"), ((F.unix_micros(F.max("landed_at")) - F.unix_micros(F.min("landed_at"))) / 1e6).alias("seconds"))
    rate = lambda c: F.round(F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds")), 6)
    return sums.select("branch_id", "positions", "graded", F.round("seconds", 3).alias("seconds"), rate("positions").alias("positions_a_second"), rate("graded").alias("graded_a_second"))


def limiting_cause(spark, folder):
    """Shares that stages ask for beside those of the compiled schedule, and
    what keeps them apart: the floor, the batch's whole sequences, or nothing."""
    got = mixes.compile_schedule(spark, folder).groupBy("stage", "lane").agg(F.sum("sequences").alias("n"))
    total = got.groupBy("stage").agg(F.sum("n").alias("all"))
    m = table(spark, folder, "stage_mixture").select("stage", "lane", "target_share", F.when(~F.isnan("protected_floor"), F.col("protected_floor")).alias("floor"))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("all")), F.lit(0.0))
    rows = m.join(got, ["stage", "lane"], "left").join(total, "stage", "left").withColumn("share", share).withColumn("delta", share - F.col("target_share"))
    unit, rose = 1.0 / mixes.PER_STEP, F.col("delta") > 0
    lifted = rose & (F.col("share") + 1e-9 >= F.col("floor")) & (F.col("floor") > F.col("target_share") - 1e-9)
    # The causes' names.
    cause = (
        F.when(F.abs("delta") < 1e-9, "")
        .when(lifted, "protected_floor")
        .when((F.col("target_share") > 0) & (F.col("target_share") < unit), "below_quota_granularity")
        .when(F.abs("delta") <= unit, "integer_rounding")
        .otherwise("reallocated_from_empty_or_short_lanes")
    )
    return rows.select("stage", "lane", "target_share", F.round("share", 6).alias("share"), F.round("delta", 6).alias("delta"), cause.alias("cause"))


_F9 = ("global_step", "rank", "microbatch_id", "batch_id", "plan_hash", "packed_sample_ids", "token_span_ids", "tokens_hash", "loss_mask_hash")
_FIELDS = ", ".join(f"coalesce(payload->>'{f}', '')" for f in _F9)
_VERS = f""", vall as (select branch_id, seq, payload, event_hash, row_number() over (partition by branch_id, seq order by landed_at, event_hash) i, row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) k
  from consumption_ledger where event_hash is not null and branch_id is not null and seq is not null and type = 'consume_microbatch'),
vtwo as (select a.branch_id, a.payload pa, z.payload pz from vall a join vall z using (branch_id, seq) where a.i = 1 and z.k = 1 and a.event_hash <> z.event_hash),
vside as (select 'a' side, branch_id, pa payload from vtwo union all select 'z', branch_id, pz from vtwo),
vset as (select side, branch_id, payload->>'global_step' g, payload->>'rank' r, payload->>'microbatch_id' m, list_sort(list(distinct concat_ws(chr(1), {_FIELDS}))) fp from vside group by all),
cmp as (select coalesce(a.branch_id, z.branch_id) branch_id, coalesce(a.g, z.g) g, case when z.fp is null then 'missing' when a.fp is null then 'extra' when a.fp = z.fp then 'same' else 'mismatch' end state
  from (select * from vset where side = 'a') a full join (select * from vset where side = 'z') z on a.branch_id = z.branch_id and a.g = z.g and a.r = z.r and a.m = z.m)
"""
_DEC = ", dl as (select * from opus_decisions where decision_id is not null qualify row_number() over (partition by decision_id order by seq desc) = 1)\n"
_REPL = """, sv as (select branch_id, seq, step, unnest(from_json(payload->'opus_decision_id', '["varchar"]')) decision_id, unnest(from_json(payload->'packed_sample_ids', '["varchar"]')) sample_id, unnest(shards) shard_id, unnest(range(len(shards))) idx from mb),
fo as (select sv.branch_id, sv.step, count(*) filter (not coalesce(d.branch_id = sv.branch_id and d.step = sv.step and d.status = 'accepted', false)) n from sv left join dl d using (decision_id) group by all),
st as (select m.branch_id, m.step, count(distinct m.batch_id) = 1 and count(distinct m.plan_hash) = 1 recorded,
  bool_and(c.event_hash = sha256('{"payload":' || c.payload || ',"prev_hash":"' || c.prev_hash || '","seq":' || c.seq || ',"type":"' || c.type || '"}')) rehashed from mb m join cur c using (branch_id, seq) group by all),
rp as (select st.*, coalesce(fo.n, 0) = 0 recomputed from st left join fo using (branch_id, step))
"""
_CLAIM = """, ck as (select branch_id, checkpoint_id mark, ledger_offset.event_seq seq, tokens_consumed p, loss_bearing_tokens_consumed l from checkpoints where branch_id is not null and checkpoint_id is not null),
cc as (select branch_id, mark, 'positions' "name", p claimed from ck union all select branch_id, mark, 'loss_tokens', l from ck),
su as (select ck.branch_id, ck.mark, coalesce(sum(mb.total), 0) p, coalesce(sum(mb.loss), 0) l from ck left join mb on mb.branch_id = ck.branch_id and mb.seq <= ck.seq where ck.seq is not null and ck.branch_id in (select branch_id from mb) group by all),
cf as (select branch_id, mark, 'positions' "name", p found from su union all select branch_id, mark, 'loss_tokens', l from su),
cl as (select coalesce(c.branch_id, f.branch_id) branch_id, coalesce(c.mark, f.mark) mark, coalesce(c."name", f."name") "name", claimed, found from cc c full join cf f on c.branch_id = f.branch_id and c.mark = f.mark and c."name" = f."name")
"""
_LEARN = """, lr as (select branch_id, seq, payload p from learning_ledger where type = 'sample_learning' and branch_id is not null and seq is not null qualify row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) = 1)
"""
_SPIKE = """, sl as (select branch_id, p.step step, avg(p.loss_after) loss from lr where p.loss_after is not null and p.step is not null group by all), dl_ as (select *, loss - lag(loss) over (partition by branch_id order by step) delta from sl),
ss as (select branch_id, avg(delta) m, stddev_pop(delta) s from dl_ group by 1 having count(delta) >= 4),
sp as (select branch_id, step, row_number() over (partition by branch_id order by step) k from dl_ join ss using (branch_id) where delta > m + 1.5 * case when s = 0 then 1e-9 else s end),
sc as (select s.branch_id, s.step spike_step, d.decision_id, d.gradient_norm g from sp s join opus_decisions d on d.branch_id = s.branch_id and d.step between greatest(0, s.step - 2) and s.step
  where s.k <= 3 and d.decision_id is not null and d.gradient_norm is not null and not isnan(d.gradient_norm)),
sg as (select branch_id, spike_step, min(decision_id) decision_id, round(any_value(g), 6) gradient_norm from (select * from sc qualify g = max(g) over (partition by branch_id, spike_step)) group by all)
"""
_MILE = """, mo as (select branch_id, min(seq) filter (type in ('branch_opened', 'branch_forked')) opened, min(seq) filter (type = 'consume_microbatch') served from cur group by 1),
ml as (select branch_id, min(seq) filter (type = 'sample_learning') learnt, min(seq) filter (type = 'step_summary') summed from learning_ledger where branch_id is not null group by 1),
mi as (select coalesce(a.branch_id, b.branch_id) branch_id, opened, served, learnt, summed, coalesce(opened < served, false) and coalesce(learnt < summed, false) in_order from mo a full join ml b on a.branch_id = b.branch_id)
"""


def _checks() -> str:
    checks = {
        "end_to_end": ("mi", "not in_order"),
        "shard_immutability": ("(select s, count(distinct h) n from (select unnest(from_json(payload->'packed_sample_ids', '[\"varchar\"]')) s, unnest(from_json(payload->'tokens_hash', '[\"varchar\"]')) h from mb) group by 1)", "n > 1"),
        "tokenizer": ("(select branch_id, count(distinct tokenizer_hash) n from checkpoints group by 1)", "n <> 1"),
        "packing": ("mb", "coalesce(loss + ctx + pad <> total, true) or total <> len * json_array_length(payload->'packed_sample_ids')"),
        "mixture": ("(select coalesce(share, 0) >= protected_floor - 1e-9 kept from stage_mixture m left join ls using (stage, lane) where protected_floor is not null and not isnan(protected_floor))", "not kept"),
        "selection": ("dl", "status is null or reason is null"),
        "firewall": ("(select unnest(lanes) lane, loss from mb)", "lane in ('validation', 'test') and loss > 0"),
        "crash_recovery": ("cmp", "state <> 'same'"),
        "replay": ("rp", "not (recorded and rehashed and recomputed)"),
        "fork": ("(select payload->>'parent_branch_id' parent from cur where type = 'branch_forked')", "parent is null or parent not in (select branch_id from mb)"),
        "learning_trace": ("lr", "p.shard_ids is null or p.doc_ids is null or p.loss_before is null or p.loss_after is null"),
        "throughput": ("(select * from cl where claimed is not null)", "not coalesce(claimed = found, false)"),
        "completion": ("(select sv.*, d.decision_id k, l.sample_id j from sv left join dl d using (decision_id) left join (select distinct branch_id, p.step step, p.sample_id sample_id from lr) l on l.branch_id = sv.branch_id and l.step = sv.step and l.sample_id = sv.sample_id)", "k is null or j is null"),
    }
    shares = """, lt as (select stage, lane, sum(len) tokens from (select stage, len, unnest(lanes) lane from mb) group by all), ls as (select stage, lane, tokens / sum(tokens) over (partition by stage) share from lt)
"""
    each = " union all ".join(f"""select '{n}' "check", count(*) filter ({bad})::bigint bad, count(*) looked_at from {source}""" for n, (source, bad) in checks.items())
    return MB + shares + _VERS + _DEC + _REPL + _CLAIM + _LEARN + _MILE + f', ev as ({each}) select "check", bad, looked_at, bad = 0 and looked_at > 0 passed from ev'


ORACLES = {
    "reserved_compare": MB + _VERS + "select branch_id, state, count(*) microbatches, min(g::int) first_step from cmp group by all",
    "replay_derivations": MB + _DEC + _REPL + "select branch_id, count(*) steps, count(*) filter (recorded) recorded, count(*) filter (rehashed) rehashed, count(*) filter (recomputed) recomputed, bool_and(recorded and rehashed and recomputed) all_match from rp group by 1",
    "evidence_verify": MB + _CLAIM + """select branch_id, "name", case when found is null then 'unfounded' when claimed is null then 'unclaimed' when claimed = found then 'same' else 'other' end state, count(*) claims, sum(claimed)::bigint claimed, sum(found)::bigint found from cl group by all""",
    "checkpoint_provenance": MB + """, fs as (select branch_id, s, min(step) step from (select branch_id, step, unnest(shards) s from mb) group by all)
select c.branch_id, c.checkpoint_id, c.global_step step, count(f.s) shards from checkpoints c left join fs f on f.branch_id = c.branch_id and f.step < c.global_step where c.branch_id is not null and c.global_step is not null and c.checkpoint_id is not null group by all""",
    "milestone_order": MB + _MILE + "select branch_id, opened, served, learnt, summed, in_order from mi",
    "worked_example": MB + _DEC + _REPL + _LEARN + """, w as (select sv.branch_id, sv.seq, sv.idx, sv.sample_id, sv.decision_id, sv.shard_id, d.status, d.reason, l.delta from sv join dl d using (decision_id)
  join (select branch_id, p.step step, p.sample_id sample_id, arg_min(p.loss_delta, seq) delta from lr group by all) l on l.branch_id = sv.branch_id and l.step = sv.step and l.sample_id = sv.sample_id)
select branch_id, seq, idx::int idx, sample_id, decision_id, shard_id, status, reason, round(delta, 6) loss_delta from w qualify row_number() over (partition by branch_id order by seq, idx) = 1""",
    "spike_candidates": MB + _LEARN + _SPIKE + "select * from sg",
    "audit_bundle": MB + _LEARN + _SPIKE + """, cs as (select branch_id, step, sum(total) n from mb group by all), ct as (select *, sum(n) over (partition by branch_id order by step) hi, sum(n) over (partition by branch_id) al from cs),
th as (select branch_id, min(step) a, max(step) b from ct where hi - n < al * 2 / 3 and hi > al / 3 group by 1)
select branch_id, 'shards' part, count(distinct s)::bigint as value from (select branch_id, unnest(shards) s from mb) group by 1 union all select branch_id, 'interval_records', count(*) from mb where step between 6 and 11 group by 1
union all select branch_id, 'middle_first', a from th union all select branch_id, 'middle_last', b from th union all select branch_id, 'spike_step', spike_step from sg""",
    "chain_append": MB + """, h as (select branch_id, max(seq) s, arg_max(event_hash, seq) prev_hash from cur group by 1), n as (select branch_id, s + 1 seq, prev_hash, 'rollback' "type", '{"upto":' || s || '}' payload from h)
select branch_id, seq, prev_hash, sha256('{"payload":' || payload || ',"prev_hash":"' || prev_hash || '","seq":' || seq || ',"type":"rollback"}') event_hash, "type", payload from n""",
    "batch_by_step": MB + "select branch_id, step, arg_max(batch_id, seq) batch_id from mb group by all",
    "learning_view": MB + _LEARN + """select branch_id, seq, coalesce(p.step, -1) step, coalesce(p.sample_id, '') sample_id, coalesce(p.lane, '') lane, coalesce(p.curriculum_stage, '') curriculum_stage, coalesce(p.model_phase, '') model_phase,
  coalesce(p.checkpoint_before, '') checkpoint_before, coalesce(p.opus_decision_id, '') opus_decision_id, coalesce(p.loss_before, 0) loss_before, coalesce(p.loss_after, 0) loss_after, coalesce(p.loss_delta, 0) loss_delta, coalesce(p.gradient_norm, 0) gradient_norm,
  coalesce(p.loss_bearing_tokens, 0) loss_bearing_tokens, coalesce(p.repeated_pass_number, 0) repeated_pass_number, coalesce(len(p.shard_ids), 0)::int shards from lr""",
    "checkpoint_state_hash": """select checkpoint_id, sha256(concat_ws('|', coalesce(checkpoint_id, '-'), coalesce(run_id, '-'), coalesce(branch_id, '-'), coalesce(global_step::varchar, '-'), coalesce(stage, '-'), coalesce(ledger_offset.event_seq::varchar, '-'), coalesce(ledger_offset.last_event_hash, '-'),
  coalesce(rng_fingerprint, '-'), coalesce(tokenizer_hash, '-'), coalesce(schedule_hash, '-'), coalesce(config_hash, '-'), coalesce(parent_checkpoint_id, '-'), coalesce(tokens_consumed::varchar, '-'), coalesce(next_expected_plan_hash, '-')))[1:16] state_hash from checkpoints""",
    "validation_reads": MB + "select branch_id, count(*) samples, count(*) filter (lane in ('validation', 'test')) held_out_reads, count(*) filter (lane in ('validation', 'test') and loss > 0) gradient_reads from (select branch_id, loss, unnest(lanes) lane from mb) group by 1",
    "phase_timers": """with t as (select coalesce(status, 'none') status, 'run' timer, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 s from ingest_runs union all select coalesce(status, 'none'), 'behind', (epoch_us(started_at) - epoch_us(read_upto)) / 1e6 from ingest_runs)
select status, timer, count(s) runs, round(sum(s), 3) as seconds from t group by all""",
    "evidence": _checks(),
    "completion_cards": learned._CARDS + """, cm as (select * from (select *, row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) k from consumption_ledger where event_hash is not null and branch_id is not null and seq is not null) where k = 1 and type = 'consume_microbatch'),
sv as (select branch_id, shard_id, count(*) times from (select branch_id, unnest(from_json(payload->'shard_ids', '["varchar"]')) shard_id from cm) group by all)
select branch_id, coalesce(c.class, 'no_card') "class", count(*) shards, sum(times)::bigint times from sv left join cards c using (shard_id) group by all""",
    "decision_rates": "with dl as (select * from opus_decisions where decision_id is not null qualify row_number() over (partition by decision_id order by seq desc) = 1)\n"
    + "select branch_id, count(*) decisions, round(count(*) filter (status = 'accepted') / count(*), 6) acceptance, count(*) filter (coalesce(protected_floor_override, false)) overrides, count(*) filter (status in ('accepted', 'rejected', 'deferred')) = count(*) reconciled from dl group by 1",
    "throughput": MB + """, t as (select m.branch_id, sum(total)::bigint positions, sum(loss)::bigint graded, (epoch_us(max(c.landed_at)) - epoch_us(min(c.landed_at))) / 1e6 s from mb m join cur c using (branch_id, seq) group by 1)
select branch_id, positions, graded, round(s, 3) as seconds, round(case when s > 0 then positions / s end, 6) positions_a_second, round(case when s > 0 then graded / s end, 6) graded_a_second from t""",
    "limiting_cause": f"""with c as ({mixes.ORACLES['compile_schedule']}), g as (select stage, lane, sum(sequences) n from c group by all),
r as (select m.stage, m.lane, target_share, case when not isnan(protected_floor) then protected_floor end fl, coalesce(n / nullif(sum(n) over (partition by m.stage), 0), 0) sh from stage_mixture m left join g on g.stage = m.stage and g.lane = m.lane)
select stage, lane, target_share, round(sh, 6) share, round(sh - target_share, 6) delta,
  case when abs(sh - target_share) < 1e-9 then '' when sh > target_share and sh + 1e-9 >= fl and fl > target_share - 1e-9 then 'protected_floor' when target_share > 0 and target_share < 1.0 / {mixes.PER_STEP} then 'below_quota_granularity'
    when abs(sh - target_share) <= 1.0 / {mixes.PER_STEP} then 'integer_rounding' else 'reallocated_from_empty_or_short_lanes' end cause from r""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
