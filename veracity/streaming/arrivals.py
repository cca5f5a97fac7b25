"""Structured Streaming driver for arriving claim snapshots."""

from __future__ import annotations

import datetime
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veracity.plans import reports as rp
from veracity.plans.spec import CheckSpec, Policy
from veracity.plans.suite import run_suite
from veracity.session import checkpoint_dir


def _read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The history, or None where nothing was written yet. A fault while reading is raised: read as
    "no history" it would give the continuity checks full points."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


def _write_batch(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrites exactly the partitions in ``df``: a replayed batch (after a failure) never appends a
    second copy, and a snapshot's results are replaced when more of it arrives."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partitions).parquet(path))


def validate_batch(batch: DataFrame, batch_id: int, *, history_path: str, results_path: str,
                   specs: Sequence[CheckSpec], policy: Policy, snapshot_col: str = "bdx_month",
                   risk: DataFrame | None = None, closed_values: Sequence[str] | None = None,
                   as_of_year: int | None = None, run_timestamp: str | None = None) -> None:
    """Validate every snapshot that this micro-batch brings rows of, whole (with the rows of earlier
    batches), store the runs, then add the batch to the history. Each run is evaluated once."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        # the snapshot values of one batch: a handful of months, not data
        values = [r[0] for r in batch.select(snapshot_col).where(F.col(snapshot_col).isNotNull())
                  .distinct().orderBy(snapshot_col).collect()]
        history = _read_history(spark, history_path)
        if history is not None:
            history = history.where(F.col("batch_id") != batch_id).drop("batch_id")   # a replay sees no copy of itself
        everything = batch if history is None else history.unionByName(batch, allowMissingColumns=True)
        stamp = run_timestamp or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        for v in values:
            cur = everything.where(F.col(snapshot_col) == F.lit(v))
            prev_v = everything.where(F.col(snapshot_col) < F.lit(v)).agg(F.max(snapshot_col)).collect()[0][0]
            prev = everything.where(F.col(snapshot_col) == F.lit(prev_v)) if prev_v is not None else None
            run = run_suite(list(specs), policy, cur.drop(snapshot_col),
                            prev.drop(snapshot_col) if prev is not None else None, risk, closed_values, as_of_year)
            run.materialize()
            label = str(v)
            scores = rp.dq_scores_row(run, label, stamp, run.total_records(), bdx_month=label) \
                .withColumn("batch_id", F.lit(batch_id))
            checks = rp.dq_check_results(run, label, stamp).withColumn("batch_id", F.lit(batch_id)).checkpoint(eager=True)
            _write_batch(scores, os.path.join(results_path, "dq_scores"), ["quarter_id"])
            _write_batch(checks, os.path.join(results_path, "dq_check_results"), ["quarter_id"])
            _write_batch(rp.dq_issues(checks).withColumn("batch_id", F.lit(batch_id)),
                         os.path.join(results_path, "dq_issues"), ["quarter_id"])
        _write_batch(batch.withColumn("batch_id", F.lit(batch_id)), history_path, [snapshot_col, "batch_id"])
    finally:
        batch.unpersist()


def validate_arrivals(spark: SparkSession, source_path: str, schema: T.StructType, *, history_path: str,
                      results_path: str, specs: Sequence[CheckSpec], policy: Policy,
                      snapshot_col: str = "bdx_month", risk: DataFrame | None = None,
                      closed_values: Sequence[str] | None = None, as_of_year: int | None = None,
                      checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a stream over parquet files landing in ``source_path``; each micro-batch is validated.

    The stream's checkpoint goes under the shared ``spark.checkpoint.dir`` unless given.
    """
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), "veracity-arrivals")
    stream = spark.readStream.schema(schema).parquet(source_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        validate_batch(batch, batch_id, history_path=history_path, results_path=results_path, specs=specs,
                       policy=policy, snapshot_col=snapshot_col, risk=risk, closed_values=closed_values,
                       as_of_year=as_of_year)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
