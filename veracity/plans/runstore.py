"""Result tables of validation runs (S9, S10, S11) saved as a whole, and replaced by quarter (S12, A19).

A run's three tables are written to folders of their own, partitioned by quarter and run; then one entry
in a commit log makes them visible together. Readers join the tables with the log, so a run that was killed
between its writes shows no rows, and the same run can be saved again. An entry may replace its quarter: runs of the quarter
committed before it are no longer visible. Tables are pruned by quarter and run partition.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veracity.plans import reports
from veracity.plans.suite import SuiteRun
from veracity.sources.commitlog import CommitLog


def _part(text: str) -> str:
    """A partition value as Spark reads it from a folder's name."""
    return "".join(c if c.isalnum() or c in "-_. " or ord(c) > 127 else f"%{ord(c):02X}" for c in text)


class RunStore:
    """The result tables under ``path``, a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits",
                             "run_id string, quarter_id string, run_timestamp string, replaces boolean, schemas map<string,string>")

    def _folder(self, table: str, quarter_id: str, run_id: str) -> str:
        return f"{self.path}/{table}/quarter_part=q-{_part(quarter_id)}/run_part=r-{_part(run_id)}"

    def stage(self, run_id: str, quarter_id: str, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Writes a run's tables, not yet visible; what an earlier attempt of the run left is overwritten. Returns their schemas."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._folder(name, quarter_id, run_id))
        return {name: json.dumps(df.schema.jsonValue()) for name, df in tables.items()}

    def commit(self, run_id: str, quarter_id: str, run_timestamp: str, schemas: dict[str, str], replace: bool = False) -> int:
        """Makes a staged run visible; with ``replace``, it takes the place of the quarter's earlier runs."""
        return self.log.append({"run_id": run_id, "quarter_id": quarter_id, "run_timestamp": run_timestamp, "replaces": replace, "schemas": schemas})

    def committed(self, run_id: str) -> bool:
        return bool(self.log.read().where(F.col("run_id") == run_id).limit(1).count())

    def save(self, run: SuiteRun, quarter_id: str, run_timestamp: str, replace: bool = False, run_id: str | None = None, **details) -> str:
        """Evaluates a run once and saves its scores, check rows and issues together. A repeated ``run_id`` is saved once.
        ``details``: source columns of the scores table. Returns the run's id."""
        run_id = run_id or uuid.uuid4().hex
        if self.committed(run_id):
            return run_id
        run.materialize(reports.failed_records_json(run))
        results = reports.dq_check_results(run, quarter_id, run_timestamp)
        scores = reports.dq_scores_row(run, quarter_id, run_timestamp, run.total_records(), **details)
        schemas = self.stage(run_id, quarter_id, {"dq_scores": scores, "dq_check_results": results})
        # the issues are read off the written check rows, so failing identifiers are searched for once
        written = self.spark.read.schema(results.schema).parquet(self._folder("dq_check_results", quarter_id, run_id))
        schemas |= self.stage(run_id, quarter_id, {"dq_issues": reports.dq_issues(written)})
        self.commit(run_id, quarter_id, run_timestamp, schemas, replace)
        return run_id

    def runs(self) -> DataFrame:
        """The visible runs: of each quarter, the last replacing one and those after it. One row a run."""
        last = F.max(F.when(F.col("replaces"), F.col("number"))).over(Window.partitionBy("quarter_id"))
        return self.log.read().withColumn("since", F.coalesce(last, F.lit(0))).where("number >= since").drop("since")

    def read(self, table: str, quarter_id: str | None = None) -> DataFrame:
        """The visible rows of one table, all or of one quarter."""
        newest = self.log.read().orderBy(F.desc("number")).limit(1).select("schemas").first()
        if newest is None:
            raise ValueError(f"no run is stored in {self.path}")
        schema = StructType.fromJson(json.loads(newest.schemas[table]))
        rows = self.spark.read.schema(StructType(schema.fields[:]).add("quarter_part", "string").add("run_part", "string")) \
            .parquet(f"{self.path}/{table}")
        if quarter_id is not None:
            rows = rows.where(F.col("quarter_part") == f"q-{quarter_id}")
        seen = self.runs().select(F.concat(F.lit("r-"), "run_id").alias("run_part"))
        return rows.join(seen, "run_part", "left_semi").drop("quarter_part", "run_part")

    def existing_run(self, quarter_id: str) -> DataFrame:
        """Whether a visible run of the quarter is stored: one row, from the log alone."""
        return reports.existing_run(self.runs(), quarter_id)
