"""Queries over tokens, hashes, replays and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import hashing, text, tokens
from millrace.operators import ledger
from millrace.plans.ledgers import MB
from millrace.sources import table
from millrace.streaming import ledger as streams


def bpe_encode(spark, folder):
    """Tokens of every document under the vocabulary for many languages."""
    return tokens.token_counts(table(spark, folder, "documents"), ["doc_id"])


def fertility_by_lang(spark, folder):
    """Tokens per word of each language tag, over documents with words."""
    counted = tokens.token_counts(table(spark, folder, "documents").withColumn("words", text.word_count()), ["lang", "words"]).where("words > 0")
    return counted.groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), F.round(F.sum("tokens") / F.sum("words"), 4).alias("fertility"))


def pretokens(spark, folder):
    rows = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", F.size(tokens.pretokens()).alias("pieces"))


def merkle_root(spark, folder):
    rows = table(spark, folder, "documents").select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    return hashing.merkle_roots(rows, "source", "doc_id", "digest")


def derive_seed(spark, folder):
    steps = ledger.microbatches(table(spark, folder, "consumption_ledger")).select("branch_id", "step").distinct()
    return steps.select("branch_id", "step", hashing.seed_column("branch_id", "step").alias("seed"))


def replay_plan_match(spark, folder):
    """Each step's recorded batch beside the batch id of its first landing."""
    landed = table(spark, folder, "consumption_ledger").where(F.col("event_hash").isNotNull() & (F.col("type") == "consume_microbatch"))
    f = lambda n: F.get_json_object("payload", f"$.{n}")
    first = landed.groupBy("branch_id", "seq").agg(F.min_by(f("batch_id"), F.struct("landed_at", "event_hash")).alias("first"), F.max_by(f("batch_id"), F.struct("landed_at", "event_hash")).alias("last"))
    return first.groupBy("branch_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("first") == F.col("last")).alias("same"))


def build_fingerprint(spark, folder):
    """What a build depends on, as names and hashes that two builds can compare."""
    s, m = table(spark, folder, "sources"), table(spark, folder, "stage_mixture")
    one = lambda name, df, cols: df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).alias("l")).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("hash"))
    return one("sources", s, ["source_id", "lane", "licence_tier", "contamination_status"]).unionByName(one("mixture", m, ["stage", "lane", "sequence_length"]))


def span_lookup(spark, folder):
    """Recorded segments per lane whose document or shard is unknown."""
    d = table(spark, folder, "documents").select("doc_id", F.col("shard_id").alias("own_shard"))
    s = table(spark, folder, "segments").select("sample_id", "seg_no", "doc_id", "shard_id", "lane").distinct()
    joined = s.join(d, "doc_id", "left")
    return joined.groupBy("lane").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("own_shard").isNull()).alias("no_document"), F.count_if(F.col("own_shard") != F.col("shard_id")).alias("other_shard"))


def event_stream(spark, folder):
    """Events per type and day, read as a stream to its end."""
    path = f"{folder}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_folder(spark, path) else f"{folder}/events*.parquet")
    out = streams.run_to_end(streams.event_windows(stream), "millrace_events")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 4).alias("value"))


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


ORACLES = {
    "derive_seed": MB + "select distinct branch_id, step, (('0x' || sha256(branch_id || '|' || step)[1:16])::ubigint % 9223372036854775808)::bigint seed from mb",
    "replay_plan_match": """with l as (select branch_id, seq, payload->>'batch_id' b, landed_at, event_hash from consumption_ledger where event_hash is not null and type = 'consume_microbatch'),
f as (select branch_id, seq, first(b order by landed_at, event_hash) a, last(b order by landed_at, event_hash) z from l group by all)
select branch_id, count(*) records, count(*) filter (a = z) same from f group by 1""",
    "span_lookup": """select s.lane, count(*) segments, count(*) filter (d.doc_id is null) no_document, count(*) filter (d.shard_id <> s.shard_id) other_shard
from (select distinct sample_id, seg_no, doc_id, shard_id, lane from segments) s left join documents d using (doc_id) group by 1""",
    "event_stream": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) events, round(sum(value), 4) as value from events group by all",
    "build_fingerprint": """select 'sources' as name, count(*) "rows", sha256(string_agg(l, chr(10) order by l)) hash from (select source_id || '|' || lane || '|' || coalesce(licence_tier, '-') || '|' || coalesce(contamination_status, '-') l from sources)
union all select 'mixture', count(*), sha256(string_agg(l, chr(10) order by l)) from (select stage || '|' || lane || '|' || sequence_length l from stage_mixture)""",
}
QUERIES = {f.__name__: f for f in (bpe_encode, fertility_by_lang, pretokens, merkle_root, derive_seed, replay_plan_match, build_fingerprint, span_lookup, event_stream)}
