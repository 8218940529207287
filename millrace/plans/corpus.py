"""Queries over documents, shards and the firewall."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import firewall, ledger, shards
from millrace.operators.joins import lookup_join
from millrace.sources import table, tables


def _docs(spark, folder):
    return table(spark, folder, "documents")


def word_counts(spark, folder):
    return _docs(spark, folder).where(F.col("text").isNotNull()).select("doc_id", text.word_count().alias("words"))


def word_freq(spark, folder):
    return _docs(spark, folder).select(F.explode(text.words()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def content_hash(spark, folder):
    return _docs(spark, folder).select("doc_id", F.sha2("text", 256).alias("content_hash"))


def corpus_hash(spark, folder, width: int = 1000):
    """One hash of all texts: of the hashes of stretches of ids, in order."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce(F.sha2("text", 256), F.lit("")))
    rows = _docs(spark, folder).select(F.floor(F.col("doc_id") / width).alias("part"), "doc_id", line.alias("line"))
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "\n")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sha2(joined("doc_id", "line"), 256).alias("h"))
    return parts.agg(F.sum("n").alias("documents"), F.sha2(joined("part", "h"), 256).alias("corpus_hash"))


def normalize_text(spark, folder):
    return _docs(spark, folder).select("doc_id", text.normalize().alias("normal"))


def script_of(spark, folder):
    return _docs(spark, folder).where(F.col("text").isNotNull()).select("doc_id", text.script_of().alias("script_found"))


def ngram_fingerprints(spark, folder):
    """Per document, how many word runs it has and the least fingerprint."""
    prints = F.transform(text.grams(), text.fingerprint)
    both = F.transform(F.array(prints), lambda p: F.struct(F.size(p).alias("grams"), F.array_min(p).alias("least")))
    rows = _docs(spark, folder).where(F.col("text").isNotNull()).select("doc_id", F.inline_outer(both))
    return rows.where("grams > 0")


def canaries(spark, folder):
    return _docs(spark, folder).where(F.contains("text", F.lit("EVAL-CANARY-"))).select("doc_id", F.explode(text.canaries()).alias("canary"))


def source_registry(spark, folder):
    """Every source with its flags, nulls as false, and its documents."""
    size = _docs(spark, folder).groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("documents"))
    s = table(spark, folder, "sources")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return s.select("source_id", "lane", "licence_tier", flag("held_out"), flag("loss_bearing"), flag("never_train"), F.array_join(F.array_sort("capability_tags"), ",").alias("tags")).join(size, "source_id", "left").na.fill(0, ["documents"])


def training_text_stats(spark, folder):
    """Texts of sources that aren't held out, per lane."""
    d, s = tables(spark, folder, "documents", "sources")
    held = s.where(F.coalesce("held_out", F.lit(False)) | F.coalesce("never_train", F.lit(False))).select(F.col("source_id").alias("source"), F.lit(True).alias("_held")).distinct()
    return lookup_join(d, held, ["source"]).where(F.col("_held").isNull()).groupBy("lane").agg(F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"), F.sum(text.word_count()).alias("words"))


def role_spans(spark, folder):
    spans = shards.role_spans(_docs(spark, folder))
    return spans.select("doc_id", "span_no", "role", "graded", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


def reserved_lock(spark, folder):
    """Documents that a context may pack, by lane and context length."""
    contexts = table(spark, folder, "stage_mixture").groupBy("sequence_length").agg((F.max("stage") == "long-finish").alias("unlocked"))
    open_ = ~F.coalesce("reserved", F.lit(False)) | F.col("unlocked")
    d = _docs(spark, folder).groupBy("lane", F.coalesce("reserved", F.lit(False)).alias("reserved"), F.coalesce("min_context", F.lit(0)).alias("min_context")).agg(F.count(F.lit(1)).alias("n"))
    far = d.join(contexts, F.col("min_context") <= F.col("sequence_length")).where(open_)
    return far.groupBy("lane", "sequence_length").agg(F.sum("n").alias("documents"))


def contamination_exact(spark, folder):
    return firewall.exact_hits(*tables(spark, folder, "documents", "eval_items"))


def contamination_canary(spark, folder):
    return firewall.canary_hits(*tables(spark, folder, "documents", "eval_items"))


def contamination_ngram(spark, folder):
    return firewall.gram_hits(*tables(spark, folder, "documents", "eval_items"))


def worst_hit(spark, folder):
    """The item that each contaminated document holds most of."""
    hits = contamination_ngram(spark, folder)
    return hits.groupBy("doc_id").agg(F.max(F.struct("ratio", (-F.col("item_id")).alias("i"))).alias("r"), F.count(F.lit(1)).alias("hits")).select("doc_id", (-F.col("r.i")).alias("item_id"), "r.ratio", "hits")


def contamination_status(spark, folder):
    d, s, e = tables(spark, folder, "documents", "sources", "eval_items")
    return firewall.shard_status(d, s, firewall.all_hits(d, e))


def build_shards(spark, folder):
    return shards.build_shards(_docs(spark, folder))


def manifest_validation(spark, folder):
    return shards.manifests(shards.build_shards(_docs(spark, folder)))


def _gated(spark, folder):
    d, s, e = tables(spark, folder, "documents", "sources", "eval_items")
    own = d.groupBy("shard_id", "source").agg(F.sum(F.coalesce(text.word_count(), F.lit(0)) + 2).alias("token_count"))
    return shards.gate(own, s, firewall.shard_status(d, s, firewall.all_hits(d, e)))


def admission_gate(spark, folder):
    return _gated(spark, folder).select("shard_id", "source", "admitted", F.array_join("reasons", ",").alias("reasons"))


def admission_report(spark, folder):
    """Shards per reason; those without one under ``admitted``."""
    each = _gated(spark, folder).select("shard_id", F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("admitted")))).alias("reason"))
    return each.groupBy("reason").agg(F.countDistinct("shard_id").alias("shards"), F.min("shard_id").alias("first_shard"))


def shard_permission(spark, folder):
    return _gated(spark, folder).select("shard_id", "source", "permission")


def registry_summary(spark, folder):
    """Shards and tokens by lane and permission, with subtotals."""
    rows = _gated(spark, folder).rollup("lane", "permission").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("shards"), F.sum("token_count").alias("tokens"))
    return rows.select("level", "lane", "permission", "shards", "tokens")


def _served(spark, folder, *keep):
    mb = ledger.microbatches(table(spark, folder, "consumption_ledger"))
    return mb.select(*keep, F.explode("shard_ids").alias("shard_id"))


def firewall_leaks(spark, folder):
    """Served shards that had no permission to train, and how often."""
    allowed = shard_permission(spark, folder).groupBy("shard_id").agg(F.max((F.col("permission") != "train").cast("int")).alias("bad"))
    counts = _served(spark, folder, "branch_id").groupBy("branch_id", "shard_id").agg(F.count(F.lit(1)).alias("microbatches"))
    return lookup_join(counts, allowed, ["shard_id"]).where(F.coalesce("bad", F.lit(1)) == 1).select("branch_id", "shard_id", F.col("bad").isNotNull().alias("known"), "microbatches")


def batch_gate(spark, folder):
    """Microbatches by what stands against them: a shard without permission,
    a contaminated document, both or nothing."""
    d, e = tables(spark, folder, "documents", "eval_items")
    mb = ledger.microbatches(table(spark, folder, "consumption_ledger")).select("branch_id", "seq", "shard_ids", "doc_ids")
    bad_shards = shard_permission(spark, folder).where(F.col("permission") != "train").select("shard_id").distinct()
    bad_docs = firewall.all_hits(d, e).select("doc_id").distinct()
    key = ["branch_id", "seq"]
    by_shard = mb.select(*key, F.explode("shard_ids").alias("shard_id")).join(bad_shards, "shard_id").select(*key, F.lit(1).alias("shard")).distinct()
    by_doc = mb.select(*key, F.explode("doc_ids").alias("doc_id")).join(bad_docs, "doc_id").select(*key, F.lit(1).alias("doc")).distinct()
    joined = mb.select(*key).join(by_shard, key, "left").join(by_doc, key, "left")
    return joined.groupBy("branch_id", F.col("shard").isNotNull().alias("bad_shard"), F.col("doc").isNotNull().alias("bad_document")).agg(F.count(F.lit(1)).alias("microbatches"))


def firewall_report(spark, folder):
    b = table(spark, folder, "block_records").select("block_no", "side", "reason", F.explode_outer(F.split("shard_id", r"[,;|\s]+")).alias("s"))
    return b.groupBy("side", "reason").agg(F.countDistinct("block_no").alias("records"), F.countDistinct("s").alias("shards"))


_W = "regexp_extract_all(lower(replace(text, '\u0130', 'i')), '[\\p{L}\\p{N}_]+')"
_STRIP = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_GRAMS = f"""
with dw as (select doc_id, {_W} w from documents where text is not null), ew as (select item_id, {_W} w from eval_items where text is not null),
dg as (select doc_id, case when len(w) >= 8 then list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from dw),
eg as (select item_id, case when len(w) >= 8 then list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from ew)
"""
_HITS = _GRAMS + """, du as (select doc_id, unnest(g) g from dg), eu as (select item_id, len(g) n, unnest(g) g from eg),
gh as (select doc_id, item_id, count(*) matched, count(*) / max(n) ratio from du join eu using (g) group by all having count(*) / max(n) >= 0.55),
ch as (select distinct doc_id, item_id from (select doc_id, unnest(regexp_extract_all(text, 'EVAL-CANARY-[0-9a-zA-Z-]+')) canary from documents) join eval_items using (canary)),
xh as (select doc_id, e.item_id from documents d join (select sha256(text) h, max(item_id) item_id from eval_items where text is not null group by 1) e on sha256(d.text) = e.h),
dirty as (select doc_id from gh union select doc_id from ch union select doc_id from xh),
status as (select d.shard_id, d.source, case when max(coalesce(s.held_out, false) or coalesce(s.never_train, false) or s.contamination_status = 'not_scanned') then max(s.contamination_status)
  when count(x.doc_id) > 0 then 'overlap_detected' else 'scanned_clean' end status from documents d left join sources s on s.source_id = d.source left join dirty x on x.doc_id = d.doc_id group by all)
"""
_GATE = _HITS + r""", sh as (select shard_id, source, sum(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 0) + 2) token_count from documents group by all),
g0 as (select sh.*, s.lane, s.never_train, s.held_out, s.loss_bearing, list_sort(list_filter([case when token_count <= 0 then 'shard_has_no_tokens' end, case when coalesce(licence_tier, '') not in ('A', 'B', 'C') then 'licence_tier_not_trainable' end,
  case when coalesce(cleaning_pipeline, '') = '' then 'cleaning_lineage_unknown' end, case when coalesce(never_train, false) then 'never_train_flag_set' end, case when status = 'overlap_detected' then 'eval_overlap_detected' end,
  case when coalesce(status, '') <> 'scanned_clean' then 'contamination_not_scanned' end,
  case when coalesce(s.lane, '') not in ('general_web', 'code', 'math_science', 'indic', 'agentic', 'reasoning') and not coalesce(held_out, false) then 'capability_lane_unknown' end], lambda x: x is not null)) reasons
  from sh left join sources s on s.source_id = sh.source left join status using (shard_id, source)),
gate as (select *, len(reasons) = 0 admitted, case when coalesce(never_train, false) then 'test' when coalesce(held_out, false) or not coalesce(loss_bearing, false) then 'validation' when len(reasons) > 0 then 'blocked' else 'train' end permission from g0)
"""
_MB = """cur as (select * from consumption_ledger where event_hash is not null and branch_id is not null and seq is not null qualify row_number() over (partition by branch_id, seq order by landed_at desc, event_hash desc) = 1),
mb as (select branch_id, seq, from_json(payload->'shard_ids', '["varchar"]') shards, from_json(payload->'doc_ids', '["bigint"]') docs from cur where type = 'consume_microbatch')"""
_ROLE = "(user|think|tool_call|tool_result|answer)"
_BUILT = r"""
with n as (select source, doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 0) + 2 n, (row_number() over (partition by source order by doc_id) - 1) // 3 part from documents),
b as (select 'sh-' || sha256(source || '|' || part || '|' || array_to_string(list_sort(list(doc_id) over (partition by source, part)), ','))[1:10] shard_id, source, part, doc_id,
  sum(n) over (partition by source, part order by doc_id) token_end, n from n)
"""

ORACLES = {
    "word_counts": f"select doc_id, len({_W}) words from documents where text is not null",
    "word_freq": f"select word, count(*) n from (select unnest({_W}) word from documents) group by 1",
    "content_hash": "select doc_id, sha256(text) content_hash from documents",
    "corpus_hash": """with p as (select doc_id // 1000 part, count(*) n, sha256(string_agg(doc_id || ':' || coalesce(sha256(text), ''), chr(10) order by doc_id)) h from documents group by 1)
select sum(n) documents, sha256(string_agg(h, chr(10) order by part)) corpus_hash from p""",
    "normalize_text": r"select doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x{feff}\x{ad}\x{2060}\x{200b}\x{200e}\x{200f}]', '', 'g')), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^"
    + _STRIP + "+|" + _STRIP + "+$', '', 'g') || chr(10) normal from documents",
    "script_of": r"""with c as (select doc_id, len(regexp_extract_all(text, '[\x{980}-\x{9FF}]')) b, len(regexp_extract_all(text, '[\x{900}-\x{97F}]')) d, len(regexp_extract_all(text, '[\x{A80}-\x{AFF}]')) g,
  len(regexp_extract_all(text, '[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]')) l, len(regexp_extract_all(text, '[\x{B80}-\x{BFF}]')) t, len(regexp_extract_all(text, '[\x{C00}-\x{C7F}]')) e from documents where text is not null)
select doc_id, case greatest(b, d, g, l, t, e) when 0 then 'Zyyy' when b then 'Beng' when d then 'Deva' when g then 'Gujr' when l then 'Latn' when t then 'Taml' else 'Telu' end script_found from c""",
    "ngram_fingerprints": _GRAMS + "select doc_id, len(g) grams, list_min(list_transform(g, lambda x: case when len(string_split(x, ' ')) >= 8 then sha256(x)[1:16] else sha256(x) end)) least from dg where len(g) > 0",
    "canaries": "select distinct doc_id, unnest(regexp_extract_all(text, 'EVAL-CANARY-[0-9a-zA-Z-]+')) canary from documents",
    "source_registry": """select s.source_id, s.lane, licence_tier, coalesce(held_out, false) held_out, coalesce(loss_bearing, false) loss_bearing, coalesce(never_train, false) never_train, array_to_string(list_sort(capability_tags), ',') tags,
  count(d.doc_id) documents from sources s left join documents d on d.source = s.source_id group by all""",
    "training_text_stats": r"""select d.lane, count(text) texts, sum(length(text)) chars, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) words from documents d left join sources s on s.source_id = d.source
where not coalesce(held_out, false) and not coalesce(never_train, false) group by 1""",
    "role_spans": rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
m as (select *, regexp_matches(line, '^@{_ROLE}:') mk from l), r as (select *, sum(mk::int) over (partition by doc_id order by i) k, max(mk) over (partition by doc_id) any_mk from m),
p as (select doc_id, k, any_mk, max(regexp_extract(line, '^@{_ROLE}:', 1)) filter (mk) role,
  regexp_replace(string_agg(case when mk then regexp_replace(regexp_replace(line, '^@{_ROLE}:', ''), '^{_STRIP}+|{_STRIP}+$', '', 'g') else line end, chr(10) order by i), '^{_STRIP}+|{_STRIP}+$', '', 'g') txt from r group by all),
q as (select doc_id, k, case when any_mk then role else 'text' end role, txt from p where (any_mk and k > 0 and txt <> '') or not any_mk)
select doc_id, row_number() over (partition by doc_id order by k) - 1 span_no, role, role in ('text', 'think', 'tool_call', 'answer') graded, length(txt) chars, sha256(txt) text_hash from q""",
    "reserved_lock": """select d.lane, c.sequence_length, count(*) documents from documents d join (select sequence_length, max(stage) = 'long-finish' unlocked from stage_mixture group by 1) c
on coalesce(d.min_context, 0) <= c.sequence_length and (not coalesce(d.reserved, false) or c.unlocked) group by all""",
    "contamination_exact": _HITS + "select * from xh",
    "contamination_canary": _HITS + "select * from ch",
    "contamination_ngram": _HITS + "select doc_id, item_id, matched, round(ratio, 4) ratio from gh",
    "worst_hit": _HITS + "select doc_id, arg_max(item_id, round(ratio, 4) * 1000000 - item_id) item_id, round(max(ratio), 4) ratio, count(*) hits from gh group by 1",
    "contamination_status": _HITS + "select * from status",
    "build_shards": _BUILT + "select shard_id, source, part, doc_id, token_end - n token_start, token_end from b",
    "manifest_validation": _BUILT + "select shard_id, source, count(*) documents, max(token_end) token_count, 0 problems, sum(n) = max(token_end) covered from b group by all",
    "admission_gate": _GATE + "select shard_id, source, admitted, array_to_string(reasons, ',') reasons from gate",
    "admission_report": _GATE + "select reason, count(distinct shard_id) shards, min(shard_id) first_shard from (select shard_id, unnest(case when len(reasons) > 0 then reasons else ['admitted'] end) reason from gate) group by 1",
    "shard_permission": _GATE + "select shard_id, source, permission from gate",
    "registry_summary": _GATE + "select grouping(lane, permission) level, lane, permission, count(*) shards, sum(token_count) tokens from gate group by rollup (lane, permission)",
    "firewall_leaks": _GATE + f", {_MB}, " + """ok as (select shard_id, max((permission <> 'train')::int) bad from gate group by 1)
select m.branch_id, m.shard_id, any_value(ok.bad) is not null known, count(*) microbatches from (select branch_id, unnest(shards) shard_id from mb) m left join ok using (shard_id) where coalesce(ok.bad, 1) = 1 group by all""",
    "batch_gate": _GATE + f", {_MB}, " + """bs as (select distinct branch_id, seq from (select branch_id, seq, unnest(shards) shard_id from mb) where shard_id in (select shard_id from gate where permission <> 'train')),
bd as (select distinct branch_id, seq from (select branch_id, seq, unnest(docs) doc_id from mb) where doc_id in (select doc_id from dirty))
select m.branch_id, bs.seq is not null bad_shard, bd.seq is not null bad_document, count(*) microbatches from mb m left join bs using (branch_id, seq) left join bd using (branch_id, seq) group by all""",
    "firewall_report": r"select side, reason, count(distinct block_no) records, count(distinct s) shards from (select side, reason, block_no, unnest(coalesce(regexp_split_to_array(shard_id, '[,;|\s]+'), [null])) s from block_records) group by all",
}
QUERIES = {name: globals()[name] for name in ORACLES}
