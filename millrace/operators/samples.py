"""Packed windows made out: their arrays, targets and an index of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages of the curriculum from the first to the last, and the
# hints that documents give of them.
STAGES = ("ground-layer", "broad-middle", "long-finish")
HINTS = ("early", "mid", "anneal")


def hint_order(column: str = "stage_hint") -> Column:
    """0 for an early, unknown or missing hint, 1 for mid, 2 for anneal."""
    return F.when(F.col(column) == HINTS[1], 1).when(F.col(column) == HINTS[2], 2).otherwise(0)


def dominant_hints(documents: DataFrame) -> DataFrame:
    """(shard_id, hint, documents): the latest stage that a shard's documents hint at."""
    rows = documents.groupBy("shard_id").agg(F.max(hint_order()).alias("k"), F.count(F.lit(1)).alias("documents"))
    return rows.select("shard_id", F.element_at(F.array(*map(F.lit, HINTS)), F.col("k") + 1).alias("hint"), "documents")


def targets(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """(lane, window, doc_id, role, position): a row for each position that is
    learnt from: the place of a graded token that isn't the first of its
    segment. windows: of concat_chop; spans: the documents' layout."""
    graded = spans.where("graded").select("doc_id", "role", "tok_start", "tok_end")
    lo = F.greatest(F.col("tok_start"), F.col("offset") + 1)
    hi = F.least(F.col("tok_end"), F.col("offset") + F.col("length"))
    both = windows.join(graded, "doc_id").withColumn("_lo", lo).withColumn("_hi", hi).where("_lo < _hi")
    at = F.explode(F.sequence("_lo", F.col("_hi") - 1))
    return both.select("lane", "window", "doc_id", "role", "window_start", "offset", at.alias("_t")).select("lane", "window", "doc_id", "role", (F.col("window_start") + F.col("_t") - F.col("offset")).alias("position"))


def arrays(windows: DataFrame, spans: DataFrame, capacity: int) -> DataFrame:
    """(lane, window, segment_ids, position_ids, loss_mask): the parallel
    arrays of each window, padded to the capacity with segment -1, position 0
    and mask 0. A window's segments are few, so its arrays are made from one
    row of segments and one of graded stretches."""
    order = F.array_sort(F.collect_list(F.struct("window_start", "doc_id", "offset", "length")))
    made = windows.groupBy("lane", "window").agg(order.alias("_s"))
    graded = spans.where("graded").select("doc_id", "tok_start", "tok_end")
    lo = F.col("window_start") + F.greatest(F.col("tok_start"), F.col("offset") + 1) - F.col("offset")
    hi = F.col("window_start") + F.least(F.col("tok_end"), F.col("offset") + F.col("length")) - F.col("offset")
    learnt = windows.join(graded, "doc_id").select("lane", "window", lo.alias("lo"), hi.alias("hi")).where("lo < hi").groupBy("lane", "window").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_g"))
    rows = made.join(learnt, ["lane", "window"], "left")
    used = F.aggregate("_s", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    pad = F.lit(capacity) - used
    flat = lambda f: F.flatten(F.transform("_s", f))
    segments = flat(lambda s, i: F.array_repeat(i.cast("long"), s["length"].cast("int")))
    positions = flat(lambda s, i: F.sequence(F.lit(0).cast("long"), s["length"] - 1))
    # one before each stretch, zeros between: the stretches are in order and apart
    mask = F.aggregate(
        F.coalesce("_g", F.array().cast("array<struct<lo:bigint,hi:bigint>>")),
        F.array().cast("array<bigint>"),
        lambda a, g: F.concat(a, F.array_repeat(F.lit(0).cast("long"), (g["lo"] - F.size(a)).cast("int")), F.array_repeat(F.lit(1).cast("long"), (g["hi"] - g["lo"]).cast("int"))),
    )
    out = rows.select("lane", "window", segments.alias("segment_ids"), positions.alias("position_ids"), mask.alias("loss_mask"), pad.cast("int").alias("_pad"))
    fill = lambda c, n, v: F.concat(F.col(c), F.array_repeat(F.lit(v).cast("long"), n)).alias(c)
    return out.select("lane", "window", fill("segment_ids", F.col("_pad"), -1), fill("position_ids", F.col("_pad"), 0), fill("loss_mask", F.lit(capacity) - F.size("loss_mask"), 0))


def array_problems(made: DataFrame, capacity: int) -> DataFrame:
    """(lane, window, problems): which of eight rules a window's arrays break:
    arrays of one length, masks of 0 and 1, no loss on padding, none on the
    first position of a segment, positions that begin at 0 and rise by one in
    each segment, segments in one piece, no token after padding, and something
    to learn from."""
    seg, pos, mask = F.col("segment_ids"), F.col("position_ids"), F.col("loss_mask")
    rows = F.zip_with(F.zip_with(seg, pos, lambda s, p: F.struct(s.alias("s"), p.alias("p"))), mask, lambda a, m: F.struct(a["s"].alias("s"), a["p"].alias("p"), m.alias("m")))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(seg, 1, capacity - 1))
    pairs = F.zip_with(rows, before, lambda r, b: F.struct(r["s"].alias("s"), r["p"].alias("p"), r["m"].alias("m"), b.alias("b")))
    earlier = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(pos, 1, capacity - 1))
    steps = F.zip_with(pairs, earlier, lambda r, e: F.when(r["s"] < 0, r["p"] == 0).when(r["s"].eqNullSafe(r["b"]), r["p"] == e + 1).otherwise(r["p"] == 0))
    found = F.array_compact(
        F.array(
            F.when((F.size(seg) != capacity) | (F.size(pos) != capacity) | (F.size(mask) != capacity), "length"),
            F.when(F.exists(mask, lambda m: ~m.isin(0, 1)), "mask_values"),
            F.when(F.exists(rows, lambda r: (r["s"] < 0) & (r["m"] != 0)), "loss_on_padding"),
            F.when(F.exists(pairs, lambda r: (r["s"] >= 0) & ~r["s"].eqNullSafe(r["b"]) & (r["m"] != 0)), "loss_on_first"),
            F.when(F.exists(steps, lambda ok: ~F.coalesce(ok, F.lit(False))), "positions"),
            F.when(F.size(F.filter(pairs, lambda r: (r["s"] >= 0) & ~r["s"].eqNullSafe(r["b"]))) > F.size(F.array_distinct(F.filter(seg, lambda s: s >= 0))), "interleaved"),
            F.when(F.exists(pairs, lambda r: (r["s"] >= 0) & F.coalesce(r["b"] < 0, F.lit(False))), "token_after_padding"),
            F.when(~F.exists(mask, lambda m: m == 1), "nothing_learnt"),
        )
    )
    return made.select("lane", "window", found.alias("problems"))


def index(segments: DataFrame) -> DataFrame:
    """One row per recorded sample: its lane, segments, documents, shards,
    tokens and languages. Duplicate rows count once; a sample that stands in
    several lanes has the first by name."""
    one = segments.where(F.col("sample_id").isNotNull()).select("sample_id", "seg_no", "shard_id", "doc_id", "lane", "lang", "window_start", (F.col("token_end") - F.col("token_start")).alias("n")).distinct()
    return one.groupBy("sample_id").agg(
        F.min("lane").alias("lane"),
        F.count(F.lit(1)).alias("segments"),
        F.countDistinct("doc_id").alias("documents"),
        F.countDistinct("shard_id").alias("shards"),
        F.sum("n").alias("used"),
        F.countDistinct(F.lower(F.substring("lang", 1, 2))).alias("languages"),
    )


def manifest_problems(spans: DataFrame, manifests: DataFrame) -> DataFrame:
    """(shard_id, problems): all that is wrong with a manifest and its spans,
    sorted: no id, no content, an empty span, a span that ends before it
    begins, spans that overlap or leave a gap, a count that isn't that of the
    spans, or a document twice. A manifest without spans is empty; spans
    without a manifest have no count."""
    before = F.lag("token_end", 1, 0).over(Window.partitionBy("shard_id").orderBy("token_start", "token_end", "doc_id"))
    n = F.col("token_end") - F.col("token_start")
    any_ = lambda c, name: F.max(F.coalesce(c, F.lit(True)).cast("int")).alias(name)
    own = spans.withColumn("_before", before).groupBy("shard_id").agg(any_(n == 0, "empty_span"), any_(n < 0, "backward_span"), any_(F.col("token_start") < F.col("_before"), "overlap"), any_(F.col("token_start") > F.col("_before"), "gap"), F.max("token_end").alias("_end"), (F.count("doc_id") != F.countDistinct("doc_id")).cast("int").alias("document_twice"))
    both = manifests.select("shard_id", "token_count", "content_hash", F.lit(1).alias("_m")).join(own, "shard_id", "full_outer")
    flags = ["empty_span", "backward_span", "overlap", "gap", "document_twice"]
    found = F.array_compact(
        F.array(
            F.when(F.coalesce("shard_id", F.lit("")) == "", "no_id"),
            F.when(F.coalesce("content_hash", F.lit("")) == "", "no_content_hash"),
            F.when(F.col("_end").isNull(), "no_spans"),
            F.when(~F.coalesce(F.col("token_count") == F.col("_end"), F.lit(False)) & F.col("_end").isNotNull(), "other_count"),
            *[F.when(F.col(f) == 1, f) for f in flags],
        )
    )
    return both.select("shard_id", F.array_sort(found).alias("problems")).where(F.size("problems") > 0)
