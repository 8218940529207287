"""Queries over made-out windows, hints, manifests and the unigram model."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import mixture, packing, planning, samples, shards
from millrace.operators.joins import lookup_join
from millrace.plans import corpus, mixes, packs
from millrace.plans.packs import CAPACITY
from millrace.session import kept
from millrace.sources import table, tables


def _made(spark, folder):
    """The documents' windows and their layout."""
    placed = packs.layout(spark, folder)
    return packing.concat_chop(packs._items(spark, folder, placed), CAPACITY), placed


def token_trace(spark, folder):
    """The positions that are learnt from, by lane and role."""
    rows = samples.targets(*_made(spark, folder))
    return rows.groupBy("lane", "role").agg(F.count(F.lit(1)).alias("targets"), F.sum("position").alias("positions"), F.min("position").alias("first"), F.max("position").alias("last"))


def sample_arrays(spark, folder):
    """Hashes of each window's arrays, and how many positions are learnt from."""
    made = samples.arrays(*_made(spark, folder), CAPACITY)
    digest = lambda c: F.substring(F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256), 1, 16)
    return made.select("lane", "window", digest("segment_ids").alias("segments_hash"), digest("position_ids").alias("positions_hash"), digest("loss_mask").alias("mask_hash"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("loss"))


def array_rules(spark, folder):
    """Windows by the rules that their arrays break."""
    rows = samples.array_problems(samples.arrays(*_made(spark, folder), CAPACITY), CAPACITY)
    return rows.groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("windows"))


def holdout_windows(spark, folder):
    """Windows of held-out documents, packed without looking at the registry."""
    d, s = tables(spark, folder, "documents", "sources")
    held = s.where(F.coalesce("held_out", F.lit(False))).select(F.col("source_id").alias("source"), F.lit(True).alias("_held")).distinct()
    own = lookup_join(d, held, ["source"], "inner").drop("_held")
    w = packing.concat_chop(kept(packing.items(own)), CAPACITY).groupBy("lane", "window").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("segments"))
    return w.groupBy("lane").agg(F.count(F.lit(1)).alias("windows"), F.sum("used").alias("used"), F.sum("segments").alias("segments"))


def sample_index(spark, folder):
    return samples.index(table(spark, folder, "segments"))


def segment_positions(spark, folder):
    """Positions of all recorded segments, per sample and segment: they begin
    at 0 in each, wherever in the window it lies."""
    p = packing.position_ids(table(spark, folder, "segments"))
    return p.groupBy("sample_id", "segment").agg(F.count(F.lit(1)).alias("positions"), F.min("position").alias("first"), F.max("position").alias("last"), F.min("index").alias("first_index"))


def sample_lookup(spark, folder):
    """Recorded samples by lane and length class, with the first of each."""
    rows = samples.index(table(spark, folder, "segments"))
    size = F.when(F.col("used") <= 512, 512).when(F.col("used") <= 1024, 1024).otherwise(2048)
    return rows.groupBy("lane", size.alias("length")).agg(F.count(F.lit(1)).alias("samples"), F.min("sample_id").alias("first_sample"))


def dominant_hint(spark, folder):
    return samples.dominant_hints(table(spark, folder, "documents"))


def reserve_list(spark, folder):
    """Reserved documents that the contexts which unlock them may pack."""
    d, m = tables(spark, folder, "documents", "stage_mixture")
    most = m.where(F.col("stage") == samples.STAGES[-1]).agg(F.max("sequence_length").alias("n")).first()["n"] or 0
    return d.where(F.coalesce("reserved", F.lit(False)) & (F.coalesce("min_context", F.lit(0)) <= most)).select("doc_id", "lane", "shard_id")


def planned_by_lane(spark, folder):
    """Sequences and tokens that the compiled schedule plans for each lane."""
    m = table(spark, folder, "stage_mixture").select("stage", "lane", "sequence_length")
    rows = mixes.compile_schedule(spark, folder).join(m, ["stage", "lane"])
    return rows.groupBy("lane").agg(F.sum("sequences").alias("sequences"), F.sum(F.col("sequences") * F.col("sequence_length")).alias("tokens"))


def block_hashes(spark, folder, width: int = 4096):
    """Each text's hash over the hashes of its blocks, and their number."""
    d = table(spark, folder, "documents").where(F.length("text") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / width).cast("int"))
    one = F.transform(starts, lambda i: F.sha2(F.substr(F.col("text"), i * width + 1, F.lit(width)), 256))
    return d.select("doc_id", one.alias("h")).select("doc_id", F.size("h").cast("long").alias("blocks"), F.sha2(F.array_join("h", ""), 256).alias("root"))


def masked_loss(spark, folder):
    """Mean next-word loss of each lane under the corpus's word frequencies,
    over graded words only. Every word has a token before it."""
    words = shards.role_words(table(spark, folder, "documents"))
    known = words.withColumn("known", F.sum("all").over(Window.partitionBy("word")))
    lanes = known.groupBy("lane").agg(F.sum("n").alias("targets"), F.sum("all").alias("words"), F.sum(F.col("n") * F.log("known")).alias("logs"))
    # one row for each lane
    total = F.sum("words").over(Window.partitionBy())
    rows = lanes.withColumn("total", total).where("targets > 0")
    return rows.select("lane", "targets", F.round(F.log("total") - F.col("logs") / F.col("targets"), 6).alias("loss"))


def prior_check(spark, folder, tolerance: float = 0.6):
    """A model that knows nothing has the loss ln V: of a uniform guess over
    the words there are, measured word by word, beside ln V."""
    counts = table(spark, folder, "documents").select(F.explode(text.words()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    size = counts.count()
    measured = F.sum(F.col("n") * F.lit(math.log(max(1, size)))) / F.sum("n")
    return counts.agg(F.count(F.lit(1)).alias("words"), F.round(measured, 6).alias("measured")).select("words", "measured", F.round(F.log("words"), 6).alias("expected"), (F.abs(F.col("measured") - F.log("words")) < tolerance).alias("within"))


def select_by_rules(spark, folder):
    """The selection made from scores, hints and the mixture alone: quotas are
    the stage's apportioned units, a candidate matches if no shard of it hints
    at a later stage, and equal content is equal shards and tokens."""
    d, m = tables(spark, folder, "opus_decisions", "stage_mixture")
    last = d.where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(F.max_by(F.struct("branch_id", "step", "lane", "curriculum_stage", "opus_score", "shard_ids", "effective_token_estimate"), "seq").alias("r"))
    rows = last.select(F.col("decision_id").alias("candidate_id"), "r.*").where(F.col("lane").isNotNull() & F.col("branch_id").isNotNull() & F.col("step").isNotNull())
    hints = table(spark, folder, "documents").groupBy("shard_id").agg(F.max(samples.hint_order()).alias("hint"))
    named = rows.select("candidate_id", F.explode("shard_ids").alias("shard_id"))
    latest = lookup_join(named, hints, ["shard_id"]).groupBy("candidate_id").agg(F.max(F.coalesce("hint", F.lit(0))).alias("hint"))
    stage = F.when(F.col("curriculum_stage") == samples.STAGES[2], 2).when(F.col("curriculum_stage") == samples.STAGES[1], 1).otherwise(0)
    units = mixture.apportion(m.withColumn("weight", F.col("target_share")), ["stage"], mixes.PER_STEP).select(F.col("stage").alias("curriculum_stage"), "lane", F.col("units").alias("quota"))
    joined = lookup_join(rows.join(latest, "candidate_id", "left"), units, ["curriculum_stage", "lane"])
    content = F.concat_ws("|", F.array_join("shard_ids", ","), F.coalesce(F.col("effective_token_estimate").cast("string"), F.lit("")))
    keys = ["branch_id", "step", "lane"]
    cand = joined.select(*keys, "candidate_id", F.col("opus_score").alias("score"), (F.coalesce("hint", F.lit(0)) <= stage).alias("matches"), F.coalesce("quota", F.lit(0)).alias("quota"), content.alias("content"))
    found = planning.select(cand, keys, mixture.PROTECTED, content="content")
    return found.groupBy(*keys, "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first"))


def _planted(spark, folder):
    """The built shards with faults planted by rule: some spans emptied, some
    moved, some documents named twice, some manifests without a count or hash."""
    spans = shards.build_shards(table(spark, folder, "documents"))
    h = F.pmod(F.col("doc_id"), F.lit(60))
    start = F.when(h == 7, F.col("token_start") + 1).when(h == 11, F.col("token_end")).when(h == 13, F.col("token_end") + 2).when(h == 17, F.greatest(F.col("token_start") - 1, F.lit(0))).otherwise(F.col("token_start"))
    bad = spans.select("shard_id", F.when(h == 19, -1).otherwise(F.col("doc_id")).alias("doc_id"), start.alias("token_start"), "token_end")
    twice = spans.where(h == 23).select("shard_id", "doc_id", "token_end", F.col("token_end").alias("e"))
    bad = bad.unionByName(twice.select("shard_id", "doc_id", F.col("token_end").alias("token_start"), (F.col("e") + 1).alias("token_end")))
    each = spans.groupBy("shard_id").agg(F.max("token_end").alias("token_count"), F.min("doc_id").alias("k"))
    k = F.pmod(F.col("k"), F.lit(50))
    manifests = each.select("shard_id", F.when(k == 3, None).when(k == 5, F.col("token_count") + 7).otherwise(F.col("token_count")).alias("token_count"), F.when(k == 9, None).otherwise(F.sha2("shard_id", 256)).alias("content_hash"))
    return bad, manifests


def manifest_problems(spark, folder):
    spans, manifests = _planted(spark, folder)
    return samples.manifest_problems(spans, manifests).select("shard_id", F.array_join("problems", ",").alias("problems"))


_ORD = "case when stage_hint = 'mid' then 1 when stage_hint = 'anneal' then 2 else 0 end"
_IDX = """with one as (select distinct sample_id, seg_no, shard_id, doc_id, lane, lang, window_start, token_end - token_start n from segments where sample_id is not null),
ix as (select sample_id, min(lane) lane, count(*) segments, count(distinct doc_id) documents, count(distinct shard_id) shards, sum(n)::bigint used, count(distinct lower(lang[1:2])) languages from one group by 1)
"""
_WORDS = r"""with w as (select doc_id, lane, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\p{L}\p{N}_]+')) word from documents), k as (select word, count(*) a from w group by 1), t as (select sum(a) total from k)
"""
_SEG = packs._CHOP + f""", gr as (select c.lane, c."window", c.doc_id, l.role, c.window_start + greatest(l.tok_start, c."offset" + 1) - c."offset" lo, c.window_start + least(l.tok_end, c."offset" + c.length) - c."offset" hi
  from ch c join lay l on l.doc_id = c.doc_id and l.graded where greatest(l.tok_start, c."offset" + 1) < least(l.tok_end, c."offset" + c.length)),
tg as (select lane, "window", doc_id, role, unnest(range(lo::bigint, hi::bigint)) pos from gr),
sg as (select *, row_number() over (partition by lane, "window" order by window_start, doc_id, "offset", length) - 1 sno from ch),
cell as (select lane, "window", unnest(range({CAPACITY})) a_ from (select distinct lane, "window" from ch)),
fl as (select c.lane, c."window", c.a_, coalesce(s.sno, -1) sno, coalesce(c.a_ - s.window_start, 0) pos, (t.pos is not null)::int msk from cell c
  left join sg s on s.lane = c.lane and s."window" = c."window" and c.a_ >= s.window_start and c.a_ < s.window_start + s.length left join tg t on t.lane = c.lane and t."window" = c."window" and t.pos = c.a_)
"""

ORACLES = {
    "token_trace": _SEG + 'select lane, role, count(*) targets, sum(pos)::bigint positions, min(pos) "first", max(pos) "last" from tg group by all',
    "sample_arrays": _SEG + """select lane, "window"::bigint "window", sha256(string_agg(sno::bigint, ',' order by a_))[1:16] segments_hash, sha256(string_agg(pos::bigint, ',' order by a_))[1:16] positions_hash, sha256(string_agg(msk, ',' order by a_))[1:16] mask_hash, sum(msk)::bigint loss from fl group by all""",
    "array_rules": _SEG + """select case when loss = 0 then 'nothing_learnt' else '' end problems, count(*) windows from (select lane, "window", sum(msk) loss from fl group by all) group by 1""",
    "holdout_windows": packs._CHOP.replace("it as (select d.doc_id, d.lane, max(l.tok_end) size from documents d join lay l using (doc_id) group by all)", "it as (select d.doc_id, d.lane, max(l.tok_end) size from documents d join lay l using (doc_id) where d.source in (select source_id from sources where held_out) group by all)")
    + """, w as (select lane, "window", sum(length) used, count(*) n from ch group by all) select lane, count(*) windows, sum(used)::bigint used, sum(n)::bigint segments from w group by 1""",
    "sample_index": _IDX + "select * from ix",
    "segment_positions": """with o as (select distinct sample_id, seg_no, window_start, token_end - token_start n from segments), r as (select *, unnest(range(n::bigint)) i from o where n > 0)
select sample_id, seg_no segment, count(*) positions, min(i)::int "first", max(i)::int "last", min(window_start + i)::int first_index from r group by all""",
    "sample_lookup": _IDX + "select lane, (case when used <= 512 then 512 when used <= 1024 then 1024 else 2048 end)::int length, count(*) samples, min(sample_id) first_sample from ix group by all",
    "dominant_hint": f"select shard_id, (['early', 'mid', 'anneal'])[max({_ORD}) + 1] hint, count(*) documents from documents group by 1",
    "reserve_list": "select doc_id, lane, shard_id from documents where coalesce(reserved, false) and coalesce(min_context, 0) <= (select max(sequence_length) from stage_mixture where stage = 'long-finish')",
    "planned_by_lane": f"with c as ({mixes.ORACLES['compile_schedule']}) select c.lane, sum(sequences)::bigint sequences, sum(sequences * sequence_length)::bigint tokens from c join stage_mixture m on m.stage = c.stage and m.lane = c.lane group by 1",
    "block_hashes": """with b as (select doc_id, i, sha256(substring(text, (i * 4096 + 1)::bigint, 4096)) h from (select doc_id, text, unnest(range((length(text) + 4095) // 4096)) i from documents where length(text) > 0))
select doc_id, count(*) blocks, sha256(string_agg(h, '' order by i)) root from b group by 1""",
    "masked_loss": corpus.ORACLES["role_spans"].split("\nselect doc_id, row_number()")[0] + r""", g as (select q.doc_id, d.lane, unnest(regexp_extract_all(lower(replace(q.txt, 'İ', 'i')), '[\p{L}\p{N}_]+')) word from q join documents d using (doc_id) where role in ('text', 'think', 'tool_call', 'answer')),
gn as (select lane, word, count(*) n from g group by all), kk as (select word, count(*) a from (select unnest(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\p{L}\p{N}_]+')) word from documents) group by 1), t as (select sum(a) total from kk)
select lane, sum(n)::bigint targets, round(sum(-ln(a / total) * n) / sum(n), 6) loss from gn join kk using (word), t group by 1""",
    "prior_check": _WORDS + "select count(*) words, round(ln(count(*)), 6) measured, round(ln(count(*)), 6) expected, true \"within\" from k",
    "select_by_rules": f"""with last as (select * from opus_decisions where decision_id is not null qualify row_number() over (partition by decision_id order by seq desc) = 1),
hs as (select shard_id, max({_ORD}) hint from documents group by 1), dh as (select decision_id, max(coalesce(hint, 0)) hint from (select decision_id, unnest(shard_ids) shard_id from last) left join hs using (shard_id) group by 1),
e as (select stage, lane, {mixes.PER_STEP} * target_share::decimal(18,9) / sum(target_share::decimal(18,9)) over (partition by stage) x from stage_mixture), f0 as (select *, round(x, 9) y from e),
f1 as (select *, {mixes.PER_STEP} - sum(floor(y)) over (partition by stage) lft, row_number() over (partition by stage order by y - floor(y) desc, lane) r from f0), un as (select stage, lane, floor(y) + (r <= lft)::int quota from f1),
q as (select l.decision_id id, branch_id, step, l.lane, case when isnan(opus_score) then null else opus_score end sc, coalesce(hint, 0) <= case curriculum_stage when 'long-finish' then 2 when 'broad-middle' then 1 else 0 end mt,
  coalesce(quota, 0) quota, l.lane in ('indic', 'agentic', 'reasoning') safe, concat_ws('|', coalesce(array_to_string(shard_ids, ','), ''), coalesce(effective_token_estimate::varchar, '')) ct
  from last l left join dh using (decision_id) left join un on un.stage = l.curriculum_stage and un.lane = l.lane where l.lane is not null and branch_id is not null and step is not null),
b as (select *, median(sc) over (partition by branch_id, step, lane) bar, row_number() over (partition by branch_id, step, lane, ct order by round(sc, 6) desc nulls last, id) > 1 dup from q),
c as (select *, mt and coalesce(sc >= bar, false) clr from b where not dup),
m as (select *, clr and row_number() over (partition by branch_id, step, lane, clr order by round(sc, 6) desc nulls last, id) <= quota merit from c),
l as (select *, quota - sum(merit::int) over (partition by branch_id, step, lane) lft, row_number() over (partition by branch_id, step, lane, merit order by mt desc, round(sc, 6) desc nulls last, id) fr from m),
f as (select *, not merit and fr <= lft fill from l),
done as (select branch_id, step, lane, id, case when merit or fill then 'accepted' when not mt and not safe then 'rejected' else 'deferred' end status,
  case when merit then 'merit' when fill and not mt then case when safe then 'bias' else 'stage_mismatch_fill' end when fill then case when safe then 'below_threshold' else 'quota_fill' end when not mt and not safe then 'stage_mismatch' else 'below_threshold' end reason from f
  union all select branch_id, step, lane, id, 'rejected', 'duplicate' from b where dup)
select branch_id, step, lane, status, reason, count(*) n, min(id) "first" from done group by all""",
    "manifest_problems": corpus._BUILT + """, s0 as (select shard_id, doc_id, token_end - n token_start, token_end, doc_id % 60 h from b),
s1 as (select shard_id, case when h = 19 then -1 else doc_id end doc_id, case h when 7 then token_start + 1 when 11 then token_end when 13 then token_end + 2 when 17 then greatest(token_start - 1, 0) else token_start end a, token_end z from s0
  union all select shard_id, doc_id, token_end, token_end + 1 from s0 where h = 23),
s2 as (select *, lag(z, 1, 0) over (partition by shard_id order by a, z, doc_id) p from s1),
ow as (select shard_id, max((z = a)::int) e, max((z < a)::int) bw, max((a < p)::int) ov, max((a > p)::int) gp, max(z) en, (count(*) <> count(distinct doc_id))::int tw from s2 group by 1),
mf as (select shard_id, max(token_end) tc, min(doc_id) % 50 k from s0 group by 1),
al as (select shard_id, list_sort(list_filter([case when k = 9 then 'no_content_hash' end, case when k in (3, 5) or tc <> en then 'other_count' end, case when e = 1 then 'empty_span' end, case when bw = 1 then 'backward_span' end,
  case when ov = 1 then 'overlap' end, case when gp = 1 then 'gap' end, case when tw = 1 then 'document_twice' end], lambda x: x is not null)) pr from ow join mf using (shard_id))
select shard_id, array_to_string(pr, ',') problems from al where len(pr) > 0""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
