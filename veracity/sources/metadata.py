"""Snapshot lists and counts (S4, S5, S6, F1) from partition values and Parquet footers, without reading a row.

A history partitioned by its snapshot column is read through the DataSource V2 reader, into which Spark pushes
``count(*)`` by partition value; the result has one row a snapshot, and the lists, counts and previous
snapshots come from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.sources.snapshots import previous_of

_V1_SOURCES, _PUSH = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"


def pushed_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path`` through the reader that takes pushed aggregates."""
    before = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_PUSH, "true")
    spark.conf.set(_V1_SOURCES, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(_V1_SOURCES, before)


def snapshot_counts(spark: SparkSession, path: str, col: str = "bdx_month") -> DataFrame:
    """(snapshot, record_count) of a history partitioned by ``col``: one row a snapshot, from footers."""
    return pushed_table(spark, path).groupBy(col).agg(F.count(F.lit(1)).alias("record_count")).where(F.col(col).isNotNull())


def snapshot_list(spark: SparkSession, path: str, col: str = "bdx_month") -> DataFrame:
    """Every snapshot with its row count and the one before it."""
    return snapshot_counts(spark, path, col).withColumn("previous_snapshot", previous_of(col))


def count_range(spark: SparkSession, path: str, low: str, high: str, col: str = "bdx_month") -> DataFrame:
    """Rows of an inclusive range of snapshots (S5: of one, with equal bounds)."""
    counts = snapshot_counts(spark, path, col)
    kind = counts.schema[col].dataType
    return counts.where(F.col(col).between(F.lit(low).cast(kind), F.lit(high).cast(kind))) \
        .agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"))
