"""Append-only, hash-chained ledgers as tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import running_sum
from millrace.session import kept

MICROBATCH = (
    "run_id string, branch_id string, global_step int, checkpoint_id string, rank int, microbatch_id string, batch_id string, plan_hash string, curriculum_stage string, sequence_length long, "
    "packed_sample_ids array<string>, shard_ids array<string>, doc_ids array<long>, token_span_ids array<string>, mixture_lane array<string>, loss_bearing_tokens long, context_only_tokens long, pad_tokens long, "
    "total_positions long, opus_decision_id array<string>, repeated_pass_number array<int>, tokens_hash array<string>, loss_mask_hash array<string>"
)
#: Fixed value: what the first record of a ledger names as the one before.
GENESIS = "0" * 64


def current(landings: DataFrame) -> DataFrame:
    """Of each (branch_id, seq) the latest whole landing; torn landings, which
    have no event_hash, and rows without a key are left out."""
    whole = landings.where(F.col("event_hash").isNotNull() & F.col("branch_id").isNotNull() & F.col("seq").isNotNull())
    row = F.struct("prev_hash", "event_hash", "type", "payload", "landed_at")
    last = whole.groupBy("branch_id", "seq").agg(F.max_by(row, F.struct("landed_at", "event_hash")).alias("r"))
    return last.select("branch_id", "seq", "r.*")


def scan(landings: DataFrame) -> DataFrame:
    """Every landing with its state: whole, torn (cut off while it landed) or
    damaged (its payload is no JSON object)."""
    ok = F.get_json_object("payload", "$").isNotNull()
    state = F.when(F.col("event_hash").isNull(), "torn").when(~ok, "damaged").otherwise("whole")
    return landings.withColumn("state", state)


def microbatches(landings: DataFrame) -> DataFrame:
    """Current consumption records with their payload's fields."""
    rows = current(landings).where(F.col("type") == "consume_microbatch")
    p = rows.select("branch_id", "seq", "event_hash", F.from_json("payload", MICROBATCH).alias("p"))
    return p.select(
        "branch_id",
        "seq",
        "event_hash",
        F.col("p.global_step").alias("step"),
        "p.rank",
        "p.microbatch_id",
        "p.batch_id",
        "p.plan_hash",
        F.col("p.curriculum_stage").alias("stage"),
        "p.checkpoint_id",
        "p.sequence_length",
        "p.packed_sample_ids",
        "p.shard_ids",
        "p.doc_ids",
        "p.token_span_ids",
        "p.mixture_lane",
        "p.loss_bearing_tokens",
        "p.context_only_tokens",
        "p.pad_tokens",
        "p.total_positions",
        "p.opus_decision_id",
        "p.repeated_pass_number",
        "p.tokens_hash",
    )


def event_hash(seq: Column, prev_hash: Column, kind: Column, payload: Column) -> Column:
    """The hash of a record whose payload is canonical JSON already."""
    return F.sha2(F.concat(F.lit('{"payload":'), payload, F.lit(',"prev_hash":"'), prev_hash, F.lit('","seq":'), seq.cast("string"), F.lit(',"type":"'), kind, F.lit('"}')), 256)


RECORD = "branch_id string, seq long, prev_hash string, event_hash string, type string, payload string"


def heads(records: DataFrame) -> DataFrame:
    """(branch_id, seq, event_hash) of each ledger's last record."""
    last = records.groupBy("branch_id").agg(F.max(F.struct("seq", "event_hash")).alias("r"))
    return last.select("branch_id", "r.seq", "r.event_hash")


def chained(events: DataFrame, last: DataFrame) -> DataFrame:
    """Events as records that go on from their ledgers' heads.

    events: branch_id, place (their order), type, payload as canonical JSON;
    equal places are ordered by type and payload. A ledger without a head
    begins at 0. Hashing a chain is sequential, so a task has all new events
    of its ledgers, but nothing of what they hold already.
    """

    def run(new: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        seq, prev = (-1, GENESIS) if head.empty else (int(head["seq"].iloc[0]), head["event_hash"].iloc[0])
        rows = []
        for e in new.sort_values(["place", "type", "payload"], kind="stable").itertuples():
            seq += 1
            own = hashlib.sha256(f'{{"payload":{e.payload},"prev_hash":"{prev}","seq":{seq},"type":"{e.type}"}}'.encode()).hexdigest()
            rows.append((e.branch_id, seq, prev, own, e.type, e.payload))
            prev = own
        return pd.DataFrame(rows, columns=["branch_id", "seq", "prev_hash", "event_hash", "type", "payload"])

    own = events.where(F.col("branch_id").isNotNull()).select("branch_id", "place", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("payload", F.lit("null")).alias("payload"))
    return own.groupBy("branch_id").cogroup(last.select("branch_id", "seq", "event_hash").groupBy("branch_id")).applyInPandas(run, RECORD)


def chain_breaks(records: DataFrame) -> DataFrame:
    """Records that don't fit their chain: (branch_id, seq, problem).

    hash: the record's own hash is another; link: prev_hash isn't the hash of
    the record before; gap: there is no record before. The one before is found
    by its number, so a long ledger is spread over all tasks.
    """
    before = records.select("branch_id", (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_before"))
    joined = records.join(before, ["branch_id", "seq"], "left")
    own = event_hash(F.col("seq"), F.col("prev_hash"), F.col("type"), F.col("payload"))
    expected = F.when(F.col("seq") == 0, F.lit(GENESIS)).otherwise(F.col("_before"))
    problem = F.when(F.col("event_hash") != own, "hash").when(expected.isNull(), "gap").when(F.col("prev_hash") != expected, "link")
    return joined.select("branch_id", "seq", problem.alias("problem")).where(F.col("problem").isNotNull())


def chain_report(records: DataFrame) -> DataFrame:
    """Per ledger: records, breaks of each kind, and the first break."""
    total = records.groupBy("branch_id").agg(F.count(F.lit(1)).alias("records"))
    bad = chain_breaks(records).groupBy("branch_id").agg(*[F.count_if(F.col("problem") == k).alias(k) for k in ("hash", "link", "gap")], F.min("seq").alias("first_break"))
    return total.join(bad, "branch_id", "left").na.fill(0, ["hash", "link", "gap"])


def ancestors(parents: DataFrame) -> DataFrame:
    """(branch_id, ancestor, depth) of all ancestors, however far up.

    parents: branch_id, parent, one row per branch; a null parent is none.
    Each round joins the relation with itself, so it reaches twice as far: a
    chain of a thousand takes ten. Branches that are their own ancestor raise
    an error.
    """
    reach = kept(parents.where(F.col("parent").isNotNull()).select("branch_id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")))
    far = 1
    while True:
        top = reach.where(F.col("depth") == far)
        more = kept(top.join(reach.select(F.col("branch_id").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d")), "ancestor").select("branch_id", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth")))
        if more.isEmpty():
            return reach.select("branch_id", "ancestor", F.col("depth").cast("int").alias("depth"))
        if not more.where(F.col("branch_id") == F.col("ancestor")).isEmpty():
            raise ValueError("a branch is its own ancestor")
        reach, far = kept(reach.unionByName(more)), far * 2


def integrity(mb: DataFrame, per_step: int) -> DataFrame:
    """Per branch: microbatches, those served twice, steps that are missing or
    not complete, and token sums with utilisation and loss density."""
    keyed = mb.groupBy("branch_id", "step", "rank", "microbatch_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("loss_bearing_tokens", "pad_tokens", "total_positions")])
    steps = keyed.groupBy("branch_id", "step").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("distinct_microbatches"), F.count_if(F.col("n") > 1).alias("duplicates"), *[F.sum(c).alias(c) for c in ("loss_bearing_tokens", "pad_tokens", "total_positions")])
    out = steps.groupBy("branch_id").agg(
        F.sum("records").alias("records"),
        F.sum("distinct_microbatches").alias("distinct_microbatches"),
        F.sum("duplicates").alias("duplicates"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        (F.max("step") - F.min("step") + 1 - F.count(F.lit(1))).alias("missing_steps"),
        F.count_if(F.col("records") != per_step).alias("incomplete_steps"),
        *[F.sum(c).alias(c) for c in ("loss_bearing_tokens", "pad_tokens", "total_positions")],
    )
    return with_ratios(out)


def with_ratios(sums: DataFrame) -> DataFrame:
    ratio = lambda part: F.round(F.try_divide(part, F.col("total_positions")), 5)
    return sums.withColumn("utilisation", ratio(F.col("total_positions") - F.col("pad_tokens"))).withColumn("loss_density", ratio(F.col("loss_bearing_tokens")))


def missing_steps(mb: DataFrame) -> DataFrame:
    """(branch_id, step) of steps inside a branch's range without a record."""
    have = mb.select("branch_id", "step").distinct()
    every = have.groupBy("branch_id").agg(F.min("step").alias("a"), F.max("step").alias("b")).select("branch_id", F.explode(F.sequence("a", "b")).alias("step"))
    return every.join(have, ["branch_id", "step"], "left_anti")


def lane_tokens(mb: DataFrame, *by: str) -> DataFrame:
    """Sequences and tokens per lane, and per the columns ``by``."""
    each = mb.select(*by, "sequence_length", F.explode("mixture_lane").alias("lane"))
    return each.groupBy(*by, "lane").agg(F.count(F.lit(1)).alias("sequences"), F.sum("sequence_length").alias("tokens"))


def spans(mb: DataFrame, *keep: str) -> DataFrame:
    """One row per served token span: shard_id, token_start, token_end."""
    part = mb.select(*keep, "step", F.explode("token_span_ids").alias("span"))
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract(span, '^([^:]*):([0-9]+)-([0-9]+)$', {i}), '') as long)")
    return part.select(*keep, "step", "span", F.split("span", ":")[0].alias("shard_id"), number(2).alias("token_start"), number(3).alias("token_end"))


def shards_between(mb: DataFrame, start: int, end: int) -> DataFrame:
    """Shards that trained each branch in steps [start, end): spans, tokens
    with repeats, first and last step. The range reaches the parsed rows
    before spans are taken apart."""
    inside = mb.where((F.col("step") >= start) & (F.col("step") < end))
    by_span = spans(inside, "branch_id").groupBy("branch_id", "shard_id", "span").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("token_end") - F.col("token_start")).alias("size"), F.min("step").alias("a"), F.max("step").alias("b"))
    from_spans = by_span.select("branch_id", "shard_id", F.lit(1).alias("spans"), (F.col("n") * F.coalesce("size", F.lit(0))).alias("tokens"), "a", "b")
    named = inside.select("branch_id", "step", F.explode("shard_ids").alias("shard_id")).groupBy("branch_id", "shard_id").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    both = from_spans.unionByName(named.select("branch_id", "shard_id", F.lit(0).alias("spans"), F.lit(0).cast("long").alias("tokens"), "a", "b"))
    return both.groupBy("branch_id", "shard_id").agg(F.sum("spans").alias("distinct_spans"), F.sum("tokens").alias("span_tokens"), F.min("a").alias("first_step"), F.max("b").alias("last_step"))


def token_window_steps(mb: DataFrame, start: int, end: int) -> DataFrame:
    """Per branch, the whole steps that hold positions of the token window:
    (branch_id, first_step, last_step)."""
    ordered = running_sum(mb.withColumn("_step", F.col("step").cast("long")), ["branch_id"], ["_step", "seq"], "total_positions", "after")
    inside = ordered.where((F.col("after") - F.col("total_positions") < end) & (F.col("after") > start))
    return inside.groupBy("branch_id").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def rollback(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Which records a rollback to each branch's offset keeps and drops."""
    joined = records.join(offsets.select("branch_id", "event_seq"), "branch_id")
    return joined.groupBy("branch_id", "event_seq").agg(F.count_if(F.col("seq") <= F.col("event_seq")).alias("kept"), F.count_if(F.col("seq") > F.col("event_seq")).alias("dropped"), F.min(F.when(F.col("seq") > F.col("event_seq"), F.col("seq"))).alias("first_dropped"))


def rollback_guard(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Offsets whose record isn't there or has another hash than was saved."""
    there = records.select("branch_id", F.col("seq").alias("event_seq"), "event_hash")
    joined = offsets.join(there, ["branch_id", "event_seq"], "left")
    why = F.when(F.col("event_hash").isNull(), "missing").when(F.col("event_hash") != F.col("last_event_hash"), "hash")
    return joined.select("branch_id", "checkpoint_id", "event_seq", why.alias("problem")).where(F.col("problem").isNotNull())
