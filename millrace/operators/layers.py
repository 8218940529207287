"""Keyed state in a shared folder: a layer of files for every batch, by buckets of the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.commitlog import CommitLog

#: Buckets of a state's keys, and layers from which they are merged into one.
BUCKETS, LAYERS = 16, 8


def bucket(keys: list[str], buckets: int) -> Column:
    """The bucket of a row's key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Layers:
    """Reads and writes the layers of one kind of row."""

    def __init__(self, log: CommitLog, kind: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.log, self.kind, self.keys, self.schema, self.buckets = log, kind, keys, schema, buckets

    @property
    def _spark(self) -> SparkSession:
        return self.log.spark

    def write(self, rows: DataFrame) -> str:
        """Rows as files of their buckets, few where they are small; a bucket
        that a hot key makes large is split over several tasks and files."""
        path = self.log.fresh(self.kind)
        rows.withColumn("bucket", bucket(self.keys, self.buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return path

    def touched(self, *paths: str) -> list[int]:
        """The buckets that layers have rows of."""
        return sorted({int(n[7:]) for p in paths for n in self.log.names(p) if n.startswith("bucket=")})

    def read(self, paths: list[str], touched: list[int] | None = None) -> DataFrame:
        """Rows of all layers, or of some of their buckets only."""
        each = [self._spark.read.schema(f"{self.schema}, bucket int").parquet(p) for p in paths]
        rows = reduce(DataFrame.unionByName, each) if each else self._spark.createDataFrame([], f"{self.schema}, bucket int")
        return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).drop("bucket")
