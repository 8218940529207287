"""Queries on ledger upkeep: what is new, and what refers to nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import incremental, references
from millrace.operators.joins import lookup_join
from millrace.session import checkpoint_dir
from millrace.sources import tables

#: Stretches of time in which references and parents are handed to the state.
BATCHES = 5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """What the next run of the reader takes: its feed has what each branch's
    last successful run had read in one commit, and what landed since in another."""
    landings, runs = tables(spark, folder, "consumption_ledger", "ingest_runs")
    rows = landings.select("branch_id", "seq", "event_hash", "landed_at")
    marked = lookup_join(rows.where(F.col("branch_id").isNotNull()), incremental.run_marks(runs), ["branch_id"])
    before = F.coalesce(F.col("landed_at") <= F.col("mark"), F.lit(False))
    root = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    feed = incremental.Feed(spark, f"{root}/feed", "branch_id string, seq long, event_hash string, landed_at timestamp")
    reader = incremental.IncrementalReader(spark, f"{root}/reader")
    for part in (before, ~before):
        feed.append(marked.where(part).drop("mark"))
        found = reader.run(feed)
    return found.select("branch_id", "seq")


def p1_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """Per branch: records waiting, their first and last seq."""
    return p1_found(spark, folder).groupBy("branch_id").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _orphans(spark: SparkSession, folder: str) -> references.PendingOrphans:
    """The state after all references, parents and deletions came in batches,
    each at its time: a reference when it was recorded, a key when it first
    existed, its deletion as a later row."""
    learning, decisions, checkpoints = tables(spark, folder, "learning_ledger", "opus_decisions", "checkpoints")
    lo, hi = learning.agg(F.unix_micros(F.min("recorded_at")), F.unix_micros(F.max("recorded_at"))).first()
    step = 1 if lo is None else (hi - lo) // BATCHES + 1

    def batch(time: str):
        at = F.floor((F.unix_micros(time) - (lo or 0)) / step)
        return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(BATCHES - 1)), F.lit(0)).cast("int")

    refs = references.clean_refs(references.ledger_refs(learning)).withColumn("batch", batch("at"))
    index = references.parent_index(references.ledger_parents(decisions, checkpoints))
    came = F.struct(batch("first_at").alias("batch"), F.lit(None).cast("timestamp").alias("gone_at"))
    went = F.struct(F.greatest(batch("first_at"), batch("gone_at")).alias("batch"), "gone_at")
    rows = F.explode(F.when(F.col("gone_at").isNull(), F.array(came)).otherwise(F.array(came, went)))
    parents = index.select("ref_field", "ref_key", "first_at", rows.alias("r")).select("ref_field", "ref_key", "first_at", "r.gone_at", "r.batch")

    state = references.PendingOrphans(spark, f"{checkpoint_dir(spark)}/orphans-{uuid.uuid4().hex}")
    dealt = [_dealt(spark, state, rows, schema) for rows, schema in ((refs, references.REFS), (parents, references.PARENTS))]
    for k in range(BATCHES):
        state.batch(*(rows.where(F.col("batch") == k).drop("batch") for rows in dealt))
    return state


def _dealt(spark: SparkSession, state: references.PendingOrphans, rows: DataFrame, schema: str) -> DataFrame:
    """rows as a file for each batch."""
    path = state.log.fresh("dealt")
    rows.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).open().select(F.col("owner").alias("branch_id"), "seq", "ref_field", "ref_state")


def p6_by_day(spark: SparkSession, folder: str) -> DataFrame:
    named = F.when(F.col("ref_field") == "opus_decision_id", "opus_decisions").otherwise("checkpoints")
    return _orphans(spark, folder).snapshot().select(named.alias("ref_table"), "day", "ref_state", "orphans")


_P1 = """
with runs as (select branch_id, max(read_upto) c from ingest_runs where status = 'succeeded' group by 1),
land as (select l.branch_id, l.seq, l.event_hash, l.landed_at, r.c from consumption_ledger l left join runs r using (branch_id)
  where l.event_hash is not null and l.branch_id is not null and l.seq is not null and l.landed_at is not null),
ranked as (select *, row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) k,
  row_number() over (partition by branch_id, seq order by (c is not null and landed_at <= c) desc, landed_at desc, event_hash desc) j from land),
cases as (select a.branch_id, a.seq from ranked a
  left join (select * from ranked where j = 1 and landed_at <= c) b using (branch_id, seq)
  where a.k = 1 and (a.c is null or a.landed_at > a.c) and (b.event_hash is null or b.event_hash <> a.event_hash))
"""
_P6 = """
with rec as (select * from (select branch_id, seq, recorded_at, payload.opus_decision_id d, payload.checkpoint_before k,
    row_number() over (partition by branch_id, seq order by landed_at desc nulls last) n from learning_ledger) where n = 1),
refs as (select branch_id, seq, recorded_at ts, 'opus_decision_id' ref_field, d ref_key from rec where d <> ''
  union all select branch_id, seq, recorded_at, 'checkpoint_before', k from rec where k <> ''),
par as (select 'opus_decision_id' ref_field, decision_id ref_key, min(recorded_at) first_at, cast(null as timestamptz) gone_at from opus_decisions where decision_id is not null group by 2
  union all select 'checkpoint_before', checkpoint_id, min(saved_at), case when count(*) = count(deleted_at) then max(deleted_at) end from checkpoints where checkpoint_id is not null group by 2),
found as (select r.branch_id, r.seq, r.ref_field, r.ts, case when p.ref_key is null then 'missing' when p.first_at > r.ts then 'late' when p.gone_at <= r.ts then 'deleted' end ref_state
  from refs r left join par p using (ref_field, ref_key))
"""

QUERIES = {"p1_found": p1_found, "p1_backlog": p1_backlog, "p6_found": p6_found, "p6_by_day": p6_by_day}
ORACLES = {
    "p1_found": _P1 + "select branch_id, seq from cases",
    "p1_backlog": _P1 + "select branch_id, count(*) records, min(seq) first_seq, max(seq) last_seq from cases group by 1",
    "p6_found": _P6 + "select branch_id, seq, ref_field, ref_state from found where ref_state is not null",
    "p6_by_day": _P6 + """select case when ref_field = 'opus_decision_id' then 'opus_decisions' else 'checkpoints' end ref_table,
  cast(ts at time zone 'UTC' as date) as day, ref_state, count(*) orphans from found where ref_state is not null group by all""",
}
