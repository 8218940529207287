"""The subpackage's queries, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, budget, leaks, mixing, packing, sentences, topn
from millrace.session import use_checkpoints
from millrace.sources import table, tables


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.best_decisions(table(spark, folder, "opus_decisions")).select("branch_id", "step", "lane", "decision_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def _estimated(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return budget.estimate(documents, ["doc_id", *keep], budget.fit(documents))


def p2_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _estimated(spark, folder)


def p2_error(spark: SparkSession, folder: str) -> DataFrame:
    """The estimates beside the exact counts, per language."""
    named = bpe.count_tokens(table(spark, folder, "documents"), ["doc_id", "lang"]).select("doc_id", budget.language().alias("language"), "tokens")
    return budget.errors(named, _estimated(spark, folder))


def p2_slices(spark: SparkSession, folder: str) -> DataFrame:
    return budget.slices(_estimated(spark, folder, "source", "lang", "domain"))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    return budget.by_segment(_estimated(spark, folder), table(spark, folder, "segments"))


def p2_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Each scheduled lane's recorded tokens beside the estimate of today."""
    schedule, mixture = tables(spark, folder, "mixture_schedule", "stage_mixture")
    lanes = _estimated(spark, folder, "lane").groupBy(mixing.plain(F.col("lane")).alias("_lane")).agg(F.sum("tokens").alias("estimated"))
    rows = mixing.short_lanes(schedule, mixture).withColumn("_lane", mixing.plain(F.col("lane")))
    return rows.join(lanes, "_lane", "left").select("run_id", "stage", "lane", "tokens_available", F.coalesce("estimated", F.lit(0)).alias("tokens_estimated"))


def _counted(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Exact tokens of every document, encoded once and kept in the shared folder."""
    use_checkpoints(spark)
    return bpe.count_tokens(table(spark, folder, "documents"), ["doc_id", *keep]).checkpoint()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    schedule, mixture = tables(spark, folder, "mixture_schedule", "stage_mixture")
    return mixing.short_lanes(schedule, mixture).where("short").select("run_id", "stage", "lane")


def p5_mix(spark: SparkSession, folder: str) -> DataFrame:
    counted = _counted(spark, folder, "lane", "domain", "lang", "source")
    return mixing.mix(counted, table(spark, folder, "stage_mixture"))


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of every stage and lane, and the repeats."""
    mixture = table(spark, folder, "stage_mixture")
    counted = _counted(spark, folder, "lane", "domain", "lang", "source")
    return mixing.shares(mixing.mix(counted, mixture), counted, mixture)


def p5_granted(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded schedules: tokens asked and granted, and the recorded repeats
    beside those that the grant needs."""
    rows = mixing.short_lanes(*tables(spark, folder, "mixture_schedule", "stage_mixture"))
    return rows.select("run_id", "stage", "lane", "sequences_required", "tokens_available", "repeat_factor", "asked", F.round("granted", 3).alias("granted"), F.round(F.try_divide(F.col("granted"), F.col("tokens_available")), 6).alias("repeats"))


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where every text lies, in containers of the longest sequence length."""
    capacity = table(spark, folder, "stage_mixture").agg(F.max("sequence_length").alias("n")).first()["n"]
    return packing.pack(_counted(spark, folder), capacity)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, for each sequence length."""
    lengths = table(spark, folder, "stage_mixture").select("sequence_length").where("sequence_length > 0").distinct().collect()
    counted = _counted(spark, folder)
    rows = [packing.fill(packing.pack(counted, n), n) for n in sorted(r[0] for r in lengths)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(*tables(spark, folder, "documents", "sources", "eval_items"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p3_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked passage and canary with its place."""
    return _leaks(spark, folder)


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The leaking documents without what leaked."""
    return leaks.without_leaks(table(spark, folder, "documents"), _leaks(spark, folder))


def p3_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks per shard, beside the reasons block_records has for the shard."""
    return leaks.beside_blocks(table(spark, folder, "documents"), _leaks(spark, folder), table(spark, folder, "block_records"))


SENTENCE_LANES = ("general_web", "math_science", "indic")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").where(F.col("lane").isin(*SENTENCE_LANES))
    return sentences.fit_split(documents)


def p9_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per source and language, and their length, over all lanes."""
    documents = table(spark, folder, "documents")
    found = sentences.fit_split(documents).where(F.col("doc_id").isNotNull())
    each = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"))
    return documents.select("doc_id", "source", "lang").join(each, "doc_id").groupBy("source", "lang").agg(F.sum("n").alias("sentences"), F.sum("chars").alias("chars"), F.max("n").alias("most_in_a_document"))


QUERIES = {
    f.__name__: f
    for f in (p2_documents, p2_error, p2_slices, p2_segments, p2_schedule, p3_found, p3_spans, p3_clean, p3_blocked, p4_found, p5_found, p5_mix, p5_shares, p5_granted, p7_ids, p8_places, p8_fill, p9_found, p9_lengths)
}
_SHORT = """
with last as (select * from (select *, regexp_replace(lower(lane), '[_\\- ]', '', 'g') l,
    row_number() over (partition by run_id, stage, regexp_replace(lower(lane), '[_\\- ]', '', 'g') order by revision desc, compiled_at desc nulls last, tokens_available desc nulls last) k
    from mixture_schedule where run_id is not null and revision is not null) where k = 1),
rows as (select s.run_id, m.stage, m.lane, s.sequences_required * m.sequence_length asked, s.tokens_available * m.repeat_cap cap
  from last s join stage_mixture m on m.stage = s.stage and regexp_replace(lower(m.lane), '[_\\- ]', '', 'g') = s.l)
"""

ORACLES = {
    "p5_found": _SHORT + "select run_id, stage, lane from rows where asked > cap",
    "p5_granted": _SHORT.replace("s.tokens_available * m.repeat_cap cap", "s.tokens_available * m.repeat_cap cap, s.sequences_required, s.tokens_available, s.repeat_factor") + """,
lev as (select *, coalesce(cap / nullif(asked, 0), 'infinity'::double) ratio, sum(asked) over (partition by run_id, stage) budget from rows),
fil as (select *, (budget - coalesce(sum(case when asked > 0 then coalesce(cap, 0) else 0 end) over before, 0)) / nullif(budget - coalesce(sum(asked) over before, 0), 0) level,
  row_number() over (partition by run_id, stage order by ratio, lane) k from lev window before as (partition by run_id, stage order by ratio, lane rows between unbounded preceding and 1 preceding)),
fin as (select *, arg_min(level, k) filter (where ratio > level and asked > 0) over (partition by run_id, stage) water from fil)
select run_id, stage, lane, sequences_required, tokens_available, repeat_factor, asked,
  round(case when asked <= 0 then 0 when water is null then cap else least(coalesce(cap, 'infinity'::double), asked * greatest(water, 0)) end, 3) granted,
  round(case when asked <= 0 then 0 when water is null then cap else least(coalesce(cap, 'infinity'::double), asked * greatest(water, 0)) end / nullif(tokens_available, 0), 6) repeats from fin""",
    "p4_found": """
with last as (select * from (select *, row_number() over (partition by decision_id order by seq desc) k from opus_decisions where decision_id is not null) where k = 1),
ranked as (select branch_id, step, lane, decision_id, row_number() over (partition by branch_id, step, lane order by opus_score + 0.0 desc, decision_id) r
  from last where lane is not null and branch_id is not null and step is not null and opus_score is not null and not isnan(opus_score))
select branch_id, step, lane, decision_id from ranked where r <= 3""",
}
