"""Keeping evaluation material away from training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.joins import is_small, lookup_join

OVERLAP = 0.55


def permission(never_train: Column, held_out: Column, loss_bearing: Column, admitted: Column) -> Column:
    """The first that holds decides; null flags don't hold."""
    no = F.lit(False)
    return F.when(F.coalesce(never_train, no), "test").when(F.coalesce(held_out, no) | ~F.coalesce(loss_bearing, no), "validation").when(~F.coalesce(admitted, no), "blocked").otherwise("train")


def exact_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of equal texts; of equal items the last counts."""
    known = items.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("_h")).agg(F.max("item_id").alias("item_id"))
    return lookup_join(documents.select("doc_id", F.sha2("text", 256).alias("_h")), known, ["_h"], "inner").select("doc_id", "item_id")


def canary_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents in which an item's canary stands. The
    marks are taken out of each text, so an equality join finds them."""
    marks = documents.where(F.contains("text", F.lit("EVAL-CANARY-"))).select("doc_id", F.explode(text.canaries()).alias("canary"))
    known = items.where(F.col("canary").isNotNull()).select("canary", "item_id")
    return marks.join(known, "canary").select("doc_id", "item_id").distinct()


def gram_hits(documents: DataFrame, items: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, matched, ratio): documents with at least the given
    share of an item's word runs.

    The items' runs are joined as hashes; if their measured size allows they
    are broadcast, and then only runs that hit are ever moved.
    """
    runs = items.where(F.col("text").isNotNull()).select("item_id", text.gram_hashes().alias("g"))
    known = runs.select("item_id", F.size("g").alias("_n"), F.explode("g").alias("_h")).select("_h", "item_id", "_n")
    # the outer form, as the plain one would take the text apart once more to filter
    mine = documents.where(F.col("text").isNotNull()).select("doc_id", F.explode_outer(text.gram_hashes()).alias("_h"))
    hits = mine.join(F.broadcast(known) if is_small(known) else known, "_h")
    pairs = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("matched"), F.max("_n").alias("_n"))
    ratio = F.col("matched") / F.col("_n")
    return pairs.where(ratio >= threshold).select("doc_id", "item_id", "matched", F.round(ratio, 4).alias("ratio"))


def all_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The hits of all three detectors: (doc_id, item_id, detector, ratio)."""
    one = lambda df, name: df.select("doc_id", "item_id", F.lit(name).alias("detector"), F.lit(1.0).alias("ratio"))
    grams = gram_hits(documents, items).select("doc_id", "item_id", F.lit("ngram").alias("detector"), "ratio")
    return one(exact_hits(documents, items), "content_hash").unionByName(one(canary_hits(documents, items), "canary")).unionByName(grams)


def shard_status(documents: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """(shard_id, source, status): a source that was not scanned or is held out
    keeps its own status, any other's is found by the scan."""
    dirty = hits.select("doc_id").distinct().withColumn("_hit", F.lit(1))
    shards = documents.select("doc_id", "shard_id", "source").join(dirty, "doc_id", "left").groupBy("shard_id", "source").agg(F.max("_hit").alias("_hit"))
    own = sources.select(F.col("source_id").alias("source"), "contamination_status", F.coalesce("held_out", F.lit(False)).alias("_held"), F.coalesce("never_train", F.lit(False)).alias("_never"))
    status = F.when(F.col("_held") | F.col("_never") | (F.col("contamination_status") == "not_scanned"), F.col("contamination_status")).when(F.col("_hit") == 1, "overlap_detected").otherwise("scanned_clean")
    return lookup_join(shards, own, ["source"]).select("shard_id", "source", status.alias("status"))
