"""Snapshot ("bdx month") operators over one table that holds every snapshot.

All filters are plain predicates on the snapshot column, so Catalyst pushes
them into the parquet scan (and prunes partitions when the table is
partitioned by the snapshot column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Snapshot-column names tried, in order, when listing snapshots.
SNAPSHOT_CANDIDATES = ("bdx_month", "Bdx_Month", "bdx_Month", "BDX_MONTH", "evaluation_date")


def snapshot_column(columns: list[str], mode: str = "db") -> str | None:
    """Resolve the snapshot column.

    'db': first column whose name contains 'bdx' (case-insensitive), else 'bdx_month'.
    'list': first of SNAPSHOT_CANDIDATES present.
    'file': first column whose name contains 'bdx' or 'date'.
    """
    if mode == "db":
        return next((c for c in columns if "bdx" in c.lower()), "bdx_month")
    if mode == "list":
        return next((c for c in SNAPSHOT_CANDIDATES if c in columns), None)
    if mode == "file":
        return next((c for c in columns if "bdx" in c.lower() or "date" in c.lower()), None)
    raise ValueError(mode)


def _lit_like(df: DataFrame, col: str, value) -> Column:
    return F.lit(value).cast(df.schema[col].dataType)


# S4
def list_snapshots(df: DataFrame, col: str | None = None, descending: bool = True) -> DataFrame:
    """Distinct non-null snapshot values, newest first."""
    col = col or snapshot_column(df.columns, "list")
    out = df.select(col).where(F.col(col).isNotNull()).distinct()
    return out.orderBy(F.col(col).desc() if descending else F.col(col).asc())


# S1
def load_snapshot(df: DataFrame, value, col: str | None = None) -> DataFrame:
    col = col or snapshot_column(df.columns)
    return df.where(F.col(col) == _lit_like(df, col, value))


# S2
def load_range(df: DataFrame, low, high, col: str | None = None) -> DataFrame:
    """Inclusive range of snapshots."""
    col = col or snapshot_column(df.columns)
    return df.where((F.col(col) >= _lit_like(df, col, low)) & (F.col(col) <= _lit_like(df, col, high)))


# S5 / S6
def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count"))


def counts_by_snapshot(df: DataFrame, col: str | None = None) -> DataFrame:
    col = col or snapshot_column(df.columns)
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("record_count"))


# A window over all snapshots is one task, and the mapping to previous ones is broadcast: both are bounded
# by the number of snapshots, which this limit keeps to what a calendar gives.
MOST_SNAPSHOTS = 10_000


def in_order(col: str, value: Column) -> Column:
    """``value``, a window function over the ordered snapshots; raises beyond ``MOST_SNAPSHOTS`` rows."""
    many = F.row_number().over(Window.orderBy(col)) > MOST_SNAPSHOTS
    text = f"more than {MOST_SNAPSHOTS} distinct values of {col}: is it a snapshot column?"
    return F.when(many, F.raise_error(text)).otherwise(value)


def previous_of(col: str) -> Column:
    """The next lower snapshot of a table with one row a snapshot."""
    return in_order(col, F.lag(col).over(Window.orderBy(col)))


# F1
def previous_snapshot(df: DataFrame, value, col: str | None = None) -> DataFrame:
    """The next lower existing snapshot value (one row, null when ``value`` is the first or absent)."""
    col = col or snapshot_column(df.columns)
    v = _lit_like(df, col, value)
    c = F.col(col)
    return df.where(c <= v).agg(
        F.when(F.count_if(c == v) > 0, F.max(F.when(c < v, c))).alias("previous_snapshot"))


def previous_snapshots(df: DataFrame, col: str | None = None) -> DataFrame:
    """Every snapshot with its previous one (``lag`` over the distinct list: one row per snapshot,
    so the single window partition is bounded by the number of snapshots, not rows)."""
    col = col or snapshot_column(df.columns)
    snaps = df.select(col).where(F.col(col).isNotNull()).distinct()
    return snaps.withColumn("previous_snapshot", previous_of(col))


# S7
def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (the top-n is the feature; it runs as a per-partition
    take-ordered, never a full sort)."""
    order_by = order_by or df.columns[:1]
    return df.orderBy(*order_by).limit(n)


def store_history(df: DataFrame, table: str, path: str, snapshot_col: str = "bdx_month",
                  key: str = "claim_number", buckets: int = 64) -> DataFrame:
    """Store a claims history partitioned by snapshot and bucketed (and sorted) by the claim key.

    Written once, it serves every later run: snapshot loads prune partitions, and the key profile's
    per-key aggregates and their join line up with the buckets, so they need no shuffle. Size
    ``buckets`` like the shuffle partitions of the target scale (files = partitions x buckets).
    """
    (df.write.mode("overwrite").partitionBy(snapshot_col).bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
