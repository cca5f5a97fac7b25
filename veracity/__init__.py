"""veracity — table validation and quality scoring on Spark DataFrames.

A claims table (plus an optional previous snapshot and reference table) is
mapped to logical column names, coerced, checked by a suite of row-, key- and
snapshot-level checks, and scored. Row checks are fused into one aggregate
over a single scan; key checks are aggregations and joins. See README.md.
"""

from veracity.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
