"""Key state of every snapshot, kept for the next one: uniqueness, missing keys and paid sums (J1, J3, J4) of
an arriving snapshot without reading the previous claims.

A state has one row a claim key: its rows ``n`` and its paid sum, in a Parquet table bucketed and sorted by
the key. An arriving snapshot is grouped once, its state is written, and the checks are a sort-merge join of
two states with equal buckets, without an exchange on either side. A log names the states that are complete;
a snapshot that arrives again gets a new state, which takes the place of the old one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.operators import keychecks as kc
from veracity.sources.commitlog import CommitLog


@dataclass(frozen=True)
class ArrivedKeys:
    """The states (key, n, paid) of a snapshot and of the one before it, if there is one."""
    current: DataFrame
    previous: DataFrame | None
    key: str = "claim_number"
    paid: str = "total_paid"

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        """Both states under the names that the key checks use; the previous one without the null key."""
        cur = self.current.select(F.col(self.key).alias("k"), "n", F.col(self.paid).alias("cur_paid"))
        prev = self.previous.where(F.col(self.key).isNotNull()) \
            .select(F.col(self.key).alias("k"), F.col(self.paid).alias("prev_paid"), F.lit(True).alias("in_prev"))
        return cur, prev.hint("merge")

    def profile(self) -> DataFrame:
        """One row with the counts of the claim-keyed checks, as ``keychecks.key_profile`` gives them."""
        if self.previous is None:
            return kc.profile_counts(self.current.select(F.col(self.key).alias("k"), "n"), None)
        return kc.profile_counts(*self._sides())

    def duplicated(self) -> DataFrame:
        """Keys of more than one row, the null key among them."""
        return self.current.where("n > 1").select(self.key)

    def missing(self) -> DataFrame:
        """Previous keys that are absent now."""
        cur, prev = self._sides()
        return prev.join(cur, "k", "left_anti").select(F.col("k").alias(self.key))

    def decreased(self) -> DataFrame:
        """Keys whose paid sum fell or is null now."""
        cur, prev = self._sides()
        return cur.where(F.col("k").isNotNull()).join(prev, "k", "left").where(~kc.paid_ok()).select(F.col("k").alias(self.key))


class KeyStates:
    """The states under ``path``, a folder that the driver and the executors share. The number of buckets is
    kept with them: a path that has states is opened with theirs, and another number is refused. Size it like the shuffle partitions
    of one snapshot's keys."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, key: str = "claim_number", paid: str = "total_paid") -> None:
        self.spark, self.path, self.key, self.paid = spark, path.rstrip("/"), key, paid
        self.log = CommitLog(spark, f"{self.path}/commits", "snapshot string, folder string, buckets int")
        first = self.log.read().orderBy("number").limit(1).first()
        if first is not None and buckets not in (None, first.buckets):
            raise ValueError(f"{self.path} has {first.buckets} buckets, not {buckets}")
        self.buckets = first.buckets if first is not None else buckets or 64

    def _table(self, folder: str, *, of: DataFrame | None = None) -> DataFrame:
        """A state's table; ``of`` is written to it first. It needs the catalog only until its plan is made, so no entry stays."""
        name = f"veracity_keys_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (`{self.key}` STRING, n BIGINT, `{self.paid}` DOUBLE) USING parquet "
                       f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        if of is not None:
            of.write.insertInto(name)
        state = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return state

    def record(self, snapshot: str, claims: DataFrame) -> DataFrame:
        """Groups a snapshot's claims once, with partial sums before the shuffle, and keeps its state.
        ``snapshot``: a text that sorts like time ('yyyy-MM-dd HH:mm:ss')."""
        folder = f"{self.path}/states/{uuid.uuid4().hex}"
        file = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        file.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(file)
        state = kc.key_state(claims, self.key, self.paid).repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        out = self._table(folder, of=state)
        self.log.append({"snapshot": snapshot, "folder": folder, "buckets": self.buckets})
        return out

    def snapshots(self) -> DataFrame:
        """(snapshot, folder) of every snapshot with a state; one row a snapshot."""
        return self.log.read().groupBy("snapshot").agg(F.max_by("folder", "number").alias("folder"))

    def state(self, snapshot: str) -> DataFrame | None:
        row = self.snapshots().where(F.col("snapshot") == snapshot).first()
        return None if row is None else self._table(row.folder)

    def previous(self, snapshot: str) -> str | None:
        """The next lower snapshot that has a state (F1)."""
        return self.snapshots().where(F.col("snapshot") < snapshot).agg(F.max("snapshot")).first()[0]

    def arrived(self, snapshot: str) -> ArrivedKeys:
        """A recorded snapshot's keys against those of the one before it."""
        current = self.state(snapshot)
        if current is None:
            raise KeyError(snapshot)
        before = self.previous(snapshot)
        return ArrivedKeys(current, None if before is None else self.state(before), self.key, self.paid)

    def arrive(self, snapshot: str, claims: DataFrame) -> ArrivedKeys:
        """Records a snapshot and returns its keys against those of the one before it."""
        self.record(snapshot, claims)
        return self.arrived(snapshot)
