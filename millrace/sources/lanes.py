"""Lane text files, source contracts and content-addressed shard files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = (
    "source_id string, file string, lane string, provenance string, licence string, licence_tier string, cleaning_pipeline string, dedup_status string, pii_status string, contamination_status string, "
    "held_out boolean, loss_bearing boolean, never_train boolean, benchmark_id string, scarce_tier string, capability_tags array<string>"
)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list under ``sources``; missing flags take their
    defaults: held_out and never_train false, loss_bearing true."""
    rows = spark.read.schema(f"sources array<struct<{SOURCE.replace(' ', ':').replace(',:', ', ')}>>").option("multiLine", True).json(path).selectExpr("inline(sources)")
    return rows.na.fill({"held_out": False, "never_train": False, "loss_bearing": True}).orderBy("source_id")


def read_lane_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of lane files: parts after ``===DOC===`` lines, each with a
    header of ``key: value`` lines, a line ``---`` and the body.

    (file, doc_id, lang, script, title, stage_hint, reserved, min_context,
    text, problem): problem names a missing separator or key and is null for a
    whole document, so bad parts can be set aside. Text before the first mark
    is no document.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = files.select("file", F.posexplode(F.split("value", r"(?m)^===DOC===[ \t]*\r?\n?")).alias("n", "part")).where((F.col("n") > 0) & (F.trim("part") != ""))
    cut = F.split("part", r"(?m)^---[ \t]*\r?\n", 2)
    head = F.map_from_entries(
        F.transform(F.filter(F.split(cut[0], r"\r?\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]), F.trim(F.split(x, ":", 2)[1])))
    )
    rows = parts.select("file", head.alias("h"), F.when(F.size(cut) == 2, cut[1]).alias("body"))
    key = lambda k: F.try_element_at(F.col("h"), F.lit(k))
    lacking = F.when(F.col("body").isNull(), "no separator")
    for k in ("doc_id", "lang", "script"):
        lacking = lacking.when(F.coalesce(key(k), F.lit("")) == "", f"no {k}")
    return rows.select(
        "file", *[key(k).alias(k) for k in ("doc_id", "lang", "script", "title", "stage_hint")],
        F.coalesce(F.lower(key("reserved")).isin("1", "true", "yes"), F.lit(False)).alias("reserved"),
        F.coalesce(key("min_context").try_cast("int"), F.lit(0)).alias("min_context"),
        F.regexp_replace(F.col("body"), r"^\s+|\s+$", "").alias("text"), lacking.alias("problem"),
    )


def write_shards(shards: DataFrame, folder: str, content: str) -> str:
    """Write to a folder named by the content's hash; an existing one is never
    written again, and a job that fails leaves no readable table."""
    target = f"{folder}/{content}"
    shards.write.mode("errorifexists").partitionBy("source").parquet(target)
    return target
