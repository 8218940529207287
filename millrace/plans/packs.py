"""Queries over packing, windows and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import packing
from millrace.session import kept
from millrace.sources import table

CAPACITY = 512


def layout(spark, folder):
    """The documents' layout, for which their texts are taken apart once."""
    return kept(packing.layout(table(spark, folder, "documents")))


def _items(spark, folder, placed=None):
    d = table(spark, folder, "documents")
    return kept(packing.items(d, layout(spark, folder) if placed is None else placed))


def doc_layout(spark, folder):
    return packing.layout(table(spark, folder, "documents"))


def pack_pad_only(spark, folder):
    return packing.pad_only(_items(spark, folder), CAPACITY)


def pack_concat_chop(spark, folder):
    return packing.concat_chop(_items(spark, folder), CAPACITY)


def pack_greedy(spark, folder):
    return packing.greedy(_items(spark, folder), CAPACITY)


def pack_best_fit(spark, folder):
    return packing.best_fit(_items(spark, folder), CAPACITY)


def pack_structure(spark, folder):
    return packing.alone(_items(spark, folder), CAPACITY)


def pack_long_context(spark, folder):
    return packing.long_context(_items(spark, folder), 1024)


def compare_policies(spark, folder):
    return packing.compare(_items(spark, folder), CAPACITY)


def deferred_documents(spark, folder):
    """Documents that the long-context policy puts off, per lane."""
    return packing.put_off(_items(spark, folder), 1024).groupBy("lane").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").cast("long").alias("tokens"), F.min("doc_id").alias("first"))


def compare_relational(spark, folder):
    """The statistics of the two policies that are relational."""
    return packing.compare(_items(spark, folder), CAPACITY, relational=True)


def packing_stats(spark, folder):
    w = packing.concat_chop(_items(spark, folder), CAPACITY).groupBy("lane", "window").agg(F.sum("length").alias("used"))
    return w.groupBy("lane").agg(F.count(F.lit(1)).alias("windows"), F.sum("used").alias("used"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("utilisation"))


def window_supply(spark, folder):
    """Windows that each lane can fill at each context length, from sizes
    alone; windows of one token don't count."""
    out, rows = None, _items(spark, folder)
    for n in (512, 1024):
        w = packing.concat_chop(rows, n).groupBy("lane", "window").agg(F.sum("length").alias("used")).where("used > 1")
        part = w.groupBy("lane").agg(F.lit(n).alias("context"), F.count(F.lit(1)).alias("windows"), F.sum("used").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


def materialise_samples(spark, folder):
    return packing.samples(packing.concat_chop(_items(spark, folder), CAPACITY))


def loss_mask(spark, folder):
    placed = layout(spark, folder)
    return packing.masks(packing.concat_chop(_items(spark, folder, placed), CAPACITY), placed, CAPACITY)


def attention_edges(spark, folder):
    """Pairs of positions that may attend, per lane of the recorded segments."""
    one = table(spark, folder, "segments").select("sample_id", "seg_no", "lane", (F.col("token_end") - F.col("token_start")).cast("long").alias("n")).distinct().where("n > 0")
    return one.groupBy("lane").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("edges"))


def mask_validation(spark, folder):
    """Recorded samples by what is wrong with their segments."""
    p = packing.segment_problems(table(spark, folder, "segments"))
    flag = lambda c: (F.col(c) > 0).alias(c)
    return p.groupBy(flag("misnumbered"), flag("empty"), flag("misplaced")).agg(F.count(F.lit(1)).alias("samples"))


def position_ids(spark, folder):
    """Positions per number of the recorded segments: how many, and their sum."""
    p = packing.position_ids(table(spark, folder, "segments"))
    return p.groupBy("segment").agg(F.count(F.lit(1)).alias("positions"), F.sum("position").alias("sum"), F.max("position").alias("last"))


_SP = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LAYOUT = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
m as (select *, regexp_matches(line, '^@(user|think|tool_call|tool_result|answer):') mk from l), r as (select *, sum(mk::int) over (partition by doc_id order by i) k, max(mk) over (partition by doc_id) any_mk from m),
p as (select doc_id, k, any_mk, max(regexp_extract(line, '^@(user|think|tool_call|tool_result|answer):', 1)) filter (mk) role,
  regexp_replace(string_agg(regexp_replace(line, '^@(user|think|tool_call|tool_result|answer):', ''), chr(10) order by i), '^{_SP}+|{_SP}+$', '', 'g') txt from r group by all),
q as (select doc_id, k, case when any_mk then role else 'text' end role, txt from p where (any_mk and k > 0 and txt <> '') or not any_mk),
n as (select doc_id, k, role, role in ('text', 'think', 'tool_call', 'answer') graded, len(regexp_extract_all(txt, '[\p{{L}}\p{{N}}_]+')) + (role <> 'text')::int n from q),
c as (select *, 1 + sum(n) over (partition by doc_id order by k) tok_end from n),
lay as (select doc_id, role, graded, tok_end - n tok_start, tok_end from c where n > 0 union all select doc_id, 'eos', true, max(tok_end), max(tok_end) + 1 from c group by 1),
it as (select d.doc_id, d.lane, max(l.tok_end) size from documents d join lay l using (doc_id) group by all),
st as (select *, sum(size) over (partition by lane order by doc_id) hi from it)
"""


def _chop(n: int, name: str = "ch") -> str:
    return f"""{name} as (select lane, w as "window", doc_id, greatest(hi - size, w * {n}) - (hi - size) "offset", least(hi, (w + 1) * {n}) - greatest(hi - size, w * {n}) length, greatest(hi - size, w * {n}) - w * {n} window_start
  from (select *, unnest(range(((hi - size) // {n})::bigint, ((hi - 1) // {n} + 1)::bigint)) w from st))"""


_CHOP = _LAYOUT + ", " + _chop(CAPACITY)
ORACLES = {
    "doc_layout": _LAYOUT + "select * from lay",
    "pack_pad_only": _LAYOUT + f"select lane, doc_id, least(size, {CAPACITY}) length, greatest(size - {CAPACITY}, 0) truncated from it",
    "pack_concat_chop": _CHOP + 'select lane, "window", doc_id, "offset", length, window_start from ch',
    "deferred_documents": _LAYOUT + """select i.lane, count(*) documents, sum(size)::bigint tokens, min(i.doc_id) "first" from it i join documents d using (doc_id)
where not coalesce(coalesce(d.min_context, 0) <= 1024 and size >= 460, false) group by 1""",
    "compare_relational": _CHOP + f""", z as (select sum(size) inp, count(*) filter (size > 0) docs from it), pa as (select count(*) windows, count(*) pieces, sum(least(size, {CAPACITY})) used from it where size > 0),
cw as (select lane, "window", sum(length) used, count(*) pieces from ch group by all), ca as (select count(*) windows, sum(pieces) pieces, sum(used) used, sum(pieces - 1) crossings from cw)
select 'pad_only' policy, {CAPACITY} capacity, windows, pieces, inp::bigint input_tokens, used::bigint used, (windows * {CAPACITY} - used)::bigint wasted, round(used / (windows * {CAPACITY}), 6) utilisation, round(used / inp, 6) retention, 0::bigint splits, (inp - used)::bigint truncated, 0::bigint deferred, 0::bigint deferred_tokens, 0::bigint crossings from pa, z
union all select 'concat_chop', {CAPACITY}, windows, pieces::bigint, inp::bigint, used::bigint, (windows * {CAPACITY} - used)::bigint, round(used / (windows * {CAPACITY}), 6), round(used / inp, 6), (pieces - docs)::bigint, (inp - used)::bigint, 0, 0, crossings::bigint from ca, z""",
    "packing_stats": _CHOP + f', w as (select lane, "window", sum(length) used from ch group by all) select lane, count(*) windows, sum(used) used, round(sum(used) / (count(*) * {CAPACITY}), 6) utilisation from w group by 1',
    "window_supply": _CHOP + ", " + _chop(1024, "ch2") + """, w as (select 512 context, lane, "window", sum(length) used from ch group by all union all select 1024, lane, "window", sum(length) from ch2 group by all)
select lane, context, count(*) windows, sum(used) tokens from w where used > 1 group by all""",
    "materialise_samples": _CHOP + """select lane, "window", 'smp-' || sha256(string_agg(doc_id || ':' || "offset"::bigint || ':' || length::bigint, ',' order by window_start, doc_id, "offset", length))[1:12] sample_id, sum(length) used from ch group by all""",
    "loss_mask": _CHOP + f""", lo as (select c.lane, c."window", sum(greatest(least(l.tok_end, c."offset" + c.length) - greatest(l.tok_start, c."offset" + 1), 0)) loss from ch c join lay l on l.doc_id = c.doc_id and l.graded group by all),
u as (select lane, "window", sum(length) used, count(*) segments, sum(length * (length + 1) / 2)::bigint edges from ch group by all)
select u.lane, u."window", segments, coalesce(loss, 0) loss, used - coalesce(loss, 0) context, {CAPACITY} - used pad, edges from u left join lo on lo.lane = u.lane and lo."window" = u."window" """,
    "attention_edges": "select lane, count(*) segments, sum(n * (n + 1) // 2) edges from (select distinct sample_id, seg_no, lane, (token_end - token_start)::bigint n from segments) where n > 0 group by 1",
    "mask_validation": """with o as (select distinct sample_id, seg_no, window_start, token_end - token_start n from segments),
c as (select *, row_number() over w - 1 k, coalesce(sum(n) over (partition by sample_id order by seg_no, window_start, n rows between unbounded preceding and 1 preceding), 0) at_ from o window w as (partition by sample_id order by seg_no, window_start, n)),
p as (select sample_id, sum(coalesce(seg_no <> k, true)::int) a, sum(coalesce(n <= 0, true)::int) b, sum(coalesce(window_start <> at_, true)::int) c from c group by 1)
select a > 0 misnumbered, b > 0 empty, c > 0 misplaced, count(*) samples from p group by all""",
    "position_ids": """select seg_no segment, sum(n) positions, sum(n::bigint * (n - 1) // 2) sum, max(n) - 1 as last from (select distinct sample_id, seg_no, window_start, token_end - token_start n from segments where window_start = 0) where n > 0 group by 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES} | {f.__name__: f for f in (pack_greedy, pack_best_fit, pack_structure, pack_long_context, compare_policies)}
