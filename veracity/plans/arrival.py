"""The monthly work on one arriving snapshot, each step building on what the one before has kept.

1. The claims are written once; that write counts the row checks (``run_suite(store_to=...)``).
2. The stored snapshot is grouped by claim key, and its key state is kept and joined with the previous one's.
3. Scores, check rows and issues are saved together and take the place of the quarter's earlier run.
4. On request, the failing rows of all checks are written in one pass.

The source is read once. A log says which stored snapshot counts, with its number of rows, so snapshots are listed, counted and
followed back without touching data. A killed arrival leaves nothing visible of the step it was in and is repeated whole;
a snapshot that arrives again replaces itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veracity.plans import reports
from veracity.plans.keystate import KeyStates
from veracity.plans.runstore import RunStore
from veracity.plans.spec import CheckSpec, Policy
from veracity.plans.suite import SuiteRun, run_suite
from veracity.sources.commitlog import CommitLog
from veracity.sources.snapshots import previous_of


class Arrivals:
    """Snapshots, key states and runs under ``path``, a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.states = KeyStates(spark, f"{self.path}/keys", buckets)
        self.runs = RunStore(spark, f"{self.path}/runs")
        self.log = CommitLog(spark, f"{self.path}/snapshots", "snapshot string, folder string, record_count long, schema string")

    def receive(self, snapshot: str, claims: DataFrame, specs: Sequence[CheckSpec], policy: Policy, quarter_id: str, run_timestamp: str,
                risk: DataFrame | None = None, closed_values: Sequence[str] | None = None, as_of_year: int | None = None,
                failures_path: str | None = None) -> SuiteRun:
        """Stores and validates the mapped ``claims`` of one snapshot. ``snapshot``: a text that sorts like time."""
        folder = f"{self.path}/claims/{uuid.uuid4().hex}"

        def keys(stored: DataFrame):
            n = stored.count()                                             # from the footers of what was just written
            self.log.append({"snapshot": snapshot, "folder": folder, "record_count": n, "schema": stored.schema.json()})
            return self.states.arrive(snapshot, stored)
        run = run_suite(specs, policy, claims, None, risk, closed_values, as_of_year, keys=keys, store_to=folder)
        self.runs.save(run, quarter_id, run_timestamp, replace=True, bdx_month=snapshot)
        if failures_path is not None:
            reports.write_failing_rows(run, failures_path)
        return run

    def snapshots(self) -> DataFrame:
        """(snapshot, record_count, previous_snapshot) of the stored snapshots (S4, S5, F1), from the log alone."""
        latest = self.log.read().groupBy("snapshot").agg(F.max_by("record_count", "number").alias("record_count"))
        return latest.withColumn("previous_snapshot", previous_of("snapshot"))

    def claims(self, snapshot: str) -> DataFrame:
        """The stored claims of one snapshot (S1)."""
        row = self.log.read().where(F.col("snapshot") == snapshot).orderBy(F.desc("number")).first()
        if row is None:
            raise KeyError(snapshot)
        return self.spark.read.schema(StructType.fromJson(json.loads(row.schema))).parquet(row.folder)
