"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Lazy scan of one table; filters and column selections reach the files.

    Days and hours are derived from instants in UTC, whatever the machine's zone.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, folder, name) for name in names)
