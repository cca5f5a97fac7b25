"""Database tables through Spark's JDBC source (snapshot loads, full scans, result appends).

Not exercised in this repository's tests: no database may be started here. The
functions only assemble standard ``DataFrameReader.jdbc`` / ``DataFrameWriter.jdbc``
options; the snapshot predicate and column pruning are pushed into the database
query by Spark's JDBC source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None,
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None,
               single_connection: bool = False) -> DataFrame:
    """A database table read in parallel: Spark issues ``num_partitions`` range queries over a numeric
    ``partition_column``. Without one the whole table would come over one connection into one task,
    which must be asked for by name (small reference tables)."""
    if not partition_column and not single_connection:
        raise ValueError("name a partition_column with its bounds, or pass single_connection=True")
    props = dict(properties or {})
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                               upperBound=upper_bound, numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def read_snapshot(spark: SparkSession, url: str, table: str, snapshot_col: str, value,
                  properties: Mapping[str, str] | None = None, **partitioning) -> DataFrame:
    """One snapshot (``WHERE snapshot_col = value``); the filter is pushed into the database query."""
    return read_table(spark, url, table, properties, **partitioning).where(F.col(snapshot_col) == F.lit(value))


def read_range(spark: SparkSession, url: str, table: str, snapshot_col: str, low, high,
               properties: Mapping[str, str] | None = None, **partitioning) -> DataFrame:
    """An inclusive range of snapshots, pushed down as two comparisons."""
    df = read_table(spark, url, table, properties, **partitioning)
    return df.where((F.col(snapshot_col) >= F.lit(low)) & (F.col(snapshot_col) <= F.lit(high)))


def append(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None,
           batch_size: int = 10000) -> None:
    """Append result rows to a database table (executors write in parallel, in batches)."""
    props = dict(properties or {})
    props.setdefault("batchsize", str(batch_size))
    df.write.jdbc(url, table, mode="append", properties=props)
