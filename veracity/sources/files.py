"""Claims from files (CSV, JSON, parquet) whose snapshot column may arrive as text.

The snapshot column is found by name ('bdx' or 'date'), parsed with the same null-on-failure date
coercion as the checks, and the snapshot filter is applied to the parsed value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions.coerce import as_timestamp, coerce_claims
from veracity.operators.mapping import CLAIMS_ALIASES, apply_mapping, auto_match
from veracity.sources.snapshots import snapshot_column


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Files of one format. CSV has a header row; give ``schema`` to skip inference on large inputs."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def with_snapshot(df: DataFrame, snapshot_col: str | None = None, out: str = "snapshot") -> DataFrame:
    """Adds ``out``: the snapshot column parsed as a timestamp (text snapshots included)."""
    col = snapshot_col or snapshot_column(df.columns, "file")
    if col is None:
        raise ValueError("no snapshot column (a name containing 'bdx' or 'date')")
    return df.withColumn(out, as_timestamp(F.col(f"`{col}`"), df.schema[col].dataType))


def list_file_snapshots(df: DataFrame, snapshot_col: str | None = None) -> DataFrame:
    """Distinct parsed snapshot values, oldest first."""
    s = with_snapshot(df, snapshot_col)
    return s.select("snapshot").where(F.col("snapshot").isNotNull()).distinct().orderBy("snapshot")


def load_file_snapshot(df: DataFrame, value: str, snapshot_col: str | None = None) -> DataFrame:
    """Rows whose parsed snapshot equals ``value`` (a 'yyyy-MM-dd[ HH:mm:ss]' text)."""
    s = with_snapshot(df, snapshot_col)
    return s.where(F.col("snapshot") == F.lit(value).cast("timestamp_ntz")).drop("snapshot")


def read_file_sets(spark: SparkSession, sets: Sequence[tuple[str, str]], aliases: Mapping[str, Sequence[str]] = CLAIMS_ALIASES,
                   options: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """File sets, each a (path, format) with headings of its own, as one table of logical columns.

    Sets with the same headings and types are read together, one scan for each different layout; headings are matched to
    logical names (P3), dates, amounts and texts coerced (P5 to P7), and the parts united by name, absent columns
    as nulls, unmatched ones left out. CSV columns are text until then, so no schema is inferred from rows. ``options``: reader options by format."""
    layouts: dict[tuple, list[str]] = {}
    for path, fmt in sets:
        reader = _reader(spark, fmt, (options or {}).get(fmt, {}))
        schema = reader.load(path).schema
        layouts.setdefault((fmt, schema.json()), []).append(path)
        if not schema.fields:
            raise ValueError(f"no columns in {path}")
    parts = []
    for (fmt, _), paths in layouts.items():
        df = _reader(spark, fmt, (options or {}).get(fmt, {})).load(paths)
        mapping = auto_match(df.columns, aliases, {lg: lg for lg in aliases})       # a logical name as heading stands for itself
        parts.append(coerce_claims(apply_mapping(df, mapping, keep_unmapped=False)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _reader(spark: SparkSession, fmt: str, options: Mapping[str, str]):
    reader = spark.read.format(fmt).options(**options)
    return reader.option("header", True).option("inferSchema", False) if fmt == "csv" else reader
