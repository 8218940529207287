"""Ledgers and events as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators.commitlog import CommitLog
from millrace.operators.ledger import RECORD, chained, heads
from millrace.session import checkpoint_dir


def follow(spark: SparkSession, source: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)


def upsert(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str):
    """Keep the newest row of each key in ``root``, exactly once per batch.

    A batch reads the last version, writes the next to a path of its own and
    commits it with the batch's number; a batch that is replayed after a crash
    finds its number and does nothing.
    """
    log = CommitLog(stream.sparkSession, root)

    def write(batch: DataFrame, number: int) -> None:
        version, state = log.latest()
        if state and state["batch"] >= number:
            return
        rows = batch if not state else batch.sparkSession.read.parquet(state["data"]).unionByName(batch)
        value = F.struct(*[c for c in batch.columns if c not in keys])
        last = rows.groupBy(*keys).agg(F.max_by(value, order).alias("r")).select(*keys, "r.*")
        target = log.fresh("data")
        last.write.parquet(target)
        log.commit(version, {"data": target, "batch": number})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_chained(stream: DataFrame, root: str, checkpoint: str):
    """Append a stream of events (branch_id, place, type, payload) to hash-chained
    ledgers in ``root``, exactly once.

    The state is a head for each ledger; a batch reads the heads, chains its
    events to them, and commits records and new heads with its number. A batch
    that is replayed after a crash finds its number and does nothing.
    """
    log = CommitLog(stream.sparkSession, root)

    def write(batch: DataFrame, number: int) -> None:
        version, state = log.latest()
        if state and state["batch"] >= number:
            return
        spark = batch.sparkSession
        known = spark.read.parquet(state["heads"]) if state else spark.createDataFrame([], "branch_id string, seq long, event_hash string")
        rows_at, heads_at = log.fresh("records"), log.fresh("heads")
        chained(batch, known).write.parquet(rows_at)
        new = spark.read.schema(RECORD).parquet(rows_at)
        heads(known.unionByName(new.select("branch_id", "seq", "event_hash"))).write.parquet(heads_at)
        log.commit(version, {"records": rows_at, "heads": heads_at, "batch": number})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, root: str) -> DataFrame:
    """All records of the ledgers in ``root``."""
    log = CommitLog(spark, root)
    paths = [log.read(v)["records"] for v in log.versions()]
    return spark.read.schema(RECORD).parquet(*paths) if paths else spark.createDataFrame([], RECORD)


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window; those later than ``late`` are let go."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def run_to_end(query_of: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Run a streaming aggregate over all there is; its newest result.

    Each batch writes the rows that it changed to the shared folder, or to
    ``root``, under its number; of a row (all columns but the numbers, which
    are sums) that several batches changed the last counts. With a ``root`` of
    its own a stream that was stopped goes on where it was.
    """
    spark = query_of.sparkSession
    base = root or f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/n={number}")

    query_of.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{base}/mark").trigger(availableNow=True).start().awaitTermination()
    keys = [f.name for f in query_of.schema if f.dataType.simpleString() in ("timestamp", "string", "date", "timestamp_ntz")]
    rest = [c for c in query_of.columns if c not in keys]
    rows = spark.read.schema(StructType([*query_of.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
