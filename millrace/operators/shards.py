"""Shards, their manifests and the gate they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.firewall import permission
from millrace.operators.joins import lookup_join
from millrace.operators.windows import running_sum

DOCS_PER_SHARD = 3
# Fixed values.
TIERS = ("A", "B", "C")
LANES = ("general_web", "code", "math_science", "indic", "agentic", "reasoning")
ROLES = ("user", "think", "tool_call", "tool_result", "answer")
GRADED = ("text", "think", "tool_call", "answer")
MARKER = f"@(?:{'|'.join(ROLES)}):"


def role_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, span_no, role, graded, text): a text with role markers at line
    starts is divided there, lines before the first are left out, as are empty
    spans; any other is one span. Null texts have none."""
    cut = F.split(F.col("text"), f"(?md)(?=^{MARKER})")
    piece = F.posexplode(cut)
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text", piece.alias("at", "piece"))
    role = F.regexp_extract("piece", f"^@({'|'.join(ROLES)}):", 1)
    marked = F.regexp_count(F.col("text"), F.lit(f"(?md)^{MARKER}")) > 0
    inline = text.SPACE.replace(r"\t-\r", r"\t\x0b-\r")
    body = F.when(role == "", F.col("piece")).otherwise(F.regexp_replace(F.regexp_replace("piece", f"^{MARKER}", ""), rf"^([^\n]*?){inline}+\n", "$1\n"))
    spans = rows.where((role != "") | ~marked).select("doc_id", "at", F.when(role == "", "text").otherwise(role).alias("role"), text.strip(body).alias("text"))
    kept = spans.where((F.col("text") != "") | (F.col("role") == "text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return kept.select("doc_id", number.alias("span_no"), "role", F.col("role").isin(*GRADED).alias("graded"), "text")


def role_words(documents: DataFrame) -> DataFrame:
    """(lane, word, all, n): how often each word stands in a lane's texts, and
    how often in their graded spans, as role_spans has them. Texts are cut at
    their markers and every word is found once: no cut falls within a word, and
    of a piece with a marker the first word is its role, which is in no span.
    Documents without an id have no spans. Words are counted where they are
    found; no text and no single word is shuffled."""
    cut = F.array(F.split("text", f"(?md)(?=^{MARKER})"))
    each = F.transform(cut, lambda c: F.transform(c, lambda p: F.struct(p.alias("piece"), (F.size(c) == 1).alias("one"))))
    pieces = documents.select("doc_id", "lane", F.inline(F.flatten(each)))
    # by piece: beside an explode it would be worked out for every word
    role = F.regexp_extract("piece", f"^@({'|'.join(ROLES)}):", 1)
    graded = F.when(role == "", F.col("one")).otherwise(role.isin(*GRADED)) & F.col("doc_id").isNotNull()
    by_piece = pieces.select("lane", graded.alias("graded"), (role != "").cast("int").alias("from"), "piece")
    found = by_piece.select("lane", "graded", "from", F.posexplode(text.words("piece")).alias("at", "word"))
    return found.groupBy("lane", "word").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("graded") & (F.col("at") >= F.col("from"))).alias("n"))


def build_shards(documents: DataFrame, size: int = DOCS_PER_SHARD) -> DataFrame:
    """(shard_id, source, part, doc_id, token_start, token_end): documents of a
    source in order of their id, ``size`` to a shard.

    A document's place in its source is counted over stretches of ids, so that
    a source that holds most documents isn't one task's. A document has a
    token for each word and two for its ends.
    """
    sized = documents.select("source", "doc_id", (F.coalesce(text.word_count(), F.lit(0)) + 2).cast("long").alias("n"), F.lit(1).cast("long").alias("_one"))
    placed = running_sum(sized, ["source"], ["doc_id"], "_one", "_place", width=None).withColumn("part", F.floor((F.col("_place") - 1) / size))
    part = Window.partitionBy("source", "part")
    run = part.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id").over(part)), lambda d: d.cast("string")), ",")
    ident = F.concat(F.lit("sh-"), F.substring(F.sha2(F.concat_ws("|", "source", F.col("part").cast("string"), names), 256), 1, 10))
    end = F.sum("n").over(run)
    return placed.select(ident.alias("shard_id"), "source", "part", "doc_id", (end - F.col("n")).alias("token_start"), end.alias("token_end"))


def manifests(spans: DataFrame) -> DataFrame:
    """One row per shard, with the problems its spans have: a span that is
    empty, or that doesn't begin where the one before ends."""
    before = F.lag("token_end", 1, 0).over(Window.partitionBy("shard_id").orderBy("token_start", "doc_id"))
    checked = spans.withColumn("_bad", ((F.col("token_start") != before) | (F.col("token_end") <= F.col("token_start"))).cast("int"))
    return checked.groupBy("shard_id", "source").agg(F.count(F.lit(1)).alias("documents"), F.max("token_end").alias("token_count"), F.sum("_bad").alias("problems"), (F.sum(F.col("token_end") - F.col("token_start")) == F.max("token_end")).alias("covered"))


def gate(shards: DataFrame, sources: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Every shard with all reasons against it, sorted; admitted if none.

    shards: shard_id, source, token_count and, optionally, tokenizer_hash.
    Without ``status`` a source's own contamination status is taken.
    """
    own = sources.select(F.col("source_id").alias("source"), "lane", "licence_tier", "cleaning_pipeline", "never_train", "held_out", "loss_bearing", "contamination_status")
    rows = lookup_join(shards, own, ["source"])
    if status is not None:
        rows = rows.join(status.select("shard_id", "source", "status"), ["shard_id", "source"], "left")
    else:
        rows = rows.withColumn("status", F.col("contamination_status"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    hashed = F.col("tokenizer_hash") if "tokenizer_hash" in shards.columns else F.lit("-")
    # The reasons' names.
    reasons = F.array(
        F.when(F.coalesce(hashed, F.lit("")) == "", "tokenizer_hash_missing"),
        F.when(F.coalesce("token_count", F.lit(0)) <= 0, "shard_has_no_tokens"),
        F.when(~F.coalesce(F.col("licence_tier").isin(*TIERS), F.lit(False)), "licence_tier_not_trainable"),
        F.when(F.coalesce("cleaning_pipeline", F.lit("")) == "", "cleaning_lineage_unknown"),
        F.when(flag("never_train"), "never_train_flag_set"),
        F.when(F.coalesce("status", F.lit("")) == "overlap_detected", "eval_overlap_detected"),
        F.when(F.coalesce("status", F.lit("")) != "scanned_clean", "contamination_not_scanned"),
        F.when(~F.coalesce(F.col("lane").isin(*LANES), F.lit(False)) & ~flag("held_out"), "capability_lane_unknown"),
    )
    rows = rows.withColumn("reasons", F.array_sort(F.array_compact(reasons))).withColumn("admitted", F.size("reasons") == 0)
    return rows.withColumn("permission", permission(F.col("never_train"), F.col("held_out"), F.col("loss_bearing"), F.col("admitted"))).select("shard_id", "source", "lane", "token_count", "admitted", "reasons", "permission")
