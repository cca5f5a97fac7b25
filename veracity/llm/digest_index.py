"""Exact deduplication against a persistent digest index.

The index is a set of Parquet tables ``(digest binary, keep_id long, batch string)``, bucketed and sorted by the SHA-256
digest of the normalised text (white space ``[\\x20\\x09-\\x0D]`` removed). A batch is reduced to one
candidate per digest, sort-merge anti-joined with the index, and what is new is appended. Built-in
functions only.

Defined results: a null text counts as empty, so null, empty and all-blank texts form one group.
Of equal texts the row with the most code points stays, then the smallest id (null ids last);
of fully repeated rows exactly one stays. Rows whose digest another batch stored earlier are all dropped
and carry the stored ``keep_id``. Other columns are ignored, whatever their names. An empty table
gives an empty result.

Skew: candidates are pre-aggregated map-side. On the way back from digests to rows, digests with
more than 1/``HOT`` of all rows (fewer than ``HOT`` of them, by that bound) are broadcast; all others
are sort-merge joined.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.scratch import Staged, new_path, parallelism, with_unique_ids, without
from veracity.sources.commitlog import CommitLog

HOT = 1024
SPACES = " \t\n\x0b\f\r"


def normalised(text: F.Column | str) -> F.Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, "")


MOST_PARTS = 8


class DigestIndex:
    """The digest tables under ``path`` (a folder that driver and executors share): a base and the batches added
    since, each bucketed and sorted by digest with one file a bucket, and a log of those that are complete. The number
    of buckets is kept in the log: an existing index is read with its own, whatever ``buckets`` says. More
    than ``MOST_PARTS`` tables are merged into a new base."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits", "kind string, folder string, batch string, buckets int")
        first = self.log.read().orderBy("number").limit(1).first()
        self.buckets = int(buckets) if first is None else first.buckets
        if first is None:
            self._commit("base", self._folder(), "")

    def _folder(self) -> str:
        path = f"{self.path}/parts/{uuid.uuid4().hex}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        return path

    def _commit(self, kind: str, folder: str, batch: str) -> None:
        self.log.append({"kind": kind, "folder": folder, "batch": batch, "buckets": self.buckets})

    def _table(self, folder: str, rows: DataFrame | None = None) -> DataFrame:
        """The table in ``folder``, after ``rows`` were written to it. It needs the catalog only until its plan is made."""
        name = f"veracity_digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        if rows is not None:
            rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest") \
                .write.insertInto(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def parts(self) -> list[DataFrame]:
        """The newest base and the batches after it: at most ``MOST_PARTS`` tables."""
        entries = self.log.read()
        base = entries.where("kind = 'base'").agg(F.max("number")).first()[0]
        return [self._table(r.folder) for r in entries.where(F.col("number") >= base).orderBy("number").collect()]

    def read(self) -> DataFrame:
        """(digest, keep_id, batch) of all that is stored."""
        return reduce(DataFrame.unionByName, self.parts())

    def absent(self, candidates: DataFrame) -> DataFrame:
        """Candidates whose digest is not stored yet."""
        return reduce(lambda c, part: c.join(part.hint("merge"), "digest", "left_anti"), self.parts(), candidates)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds ``(digest, keep_id)`` rows of one batch."""
        folder = self._folder()
        self._table(folder, rows.withColumn("batch", F.lit(batch)))
        self._commit("batch", folder, batch)
        if len(self.parts()) > MOST_PARTS:
            self.compact()

    def compact(self) -> None:
        """Merges all tables into one."""
        folder = self._folder()
        self._table(folder, self.read())
        self._commit("base", folder, "")

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """One row per row of ``docs``: doc_id, keep_id, group_size (rows of this batch with the same
        digest), kept, digest (binary) and row (a number for each row, stable once returned). ``batch`` names
        these documents: what the same batch stored before doesn't count as earlier, so a batch that is
        run again gives the same result. Without a name, every call is a batch of its own."""
        batch = batch or uuid.uuid4().hex
        norm = normalised(text_col)
        rows = Staged(docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"),
            F.monotonically_increasing_id().alias("row")), "digests").df
        best = F.max(F.struct("size", (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("at")))
        groups = rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")) \
            .select("digest", (-F.col("b.id")).alias("keep_id"), (-F.col("b.at")).alias("keep_row"), "group_size",
                    F.lit(False).alias("earlier"))
        for part in self.parts():
            stored = part.where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("stored_id"), F.lit(True).alias("stored"))
            groups = groups.join(stored.hint("merge"), "digest", "left").select(
                "digest", F.when(F.col("stored"), F.col("stored_id")).otherwise(F.col("keep_id")).alias("keep_id"), "keep_row", "group_size",
                (F.col("earlier") | F.col("stored").isNotNull()).alias("earlier"))
        groups = Staged(groups, "groups").df
        self.append(self.absent(groups.where("not earlier")), batch)
        groups = groups.withColumn("keep_row", F.when(~F.col("earlier"), F.col("keep_row"))).drop("earlier")
        total = rows.count()
        hot = groups.where(F.col("group_size") > total / HOT)
        cold = groups.where(F.col("group_size") <= total / HOT)
        back = rows.join(F.broadcast(hot), "digest").unionByName(
            rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.hint("merge"), "digest"))
        return back.select("doc_id", "keep_id", "group_size",
                           F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest", "row")


def deduplicate(docs: DataFrame, index_path: str | None = None, buckets: int | None = None,
                id_col: str = "doc_id", batch: str | None = None) -> DataFrame:
    """``docs`` against the index at ``index_path`` (a fresh one in the shared folder if None)."""
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or new_path(spark, "digest-index"), buckets or parallelism(spark))
    return index.deduplicate(docs, id_col, batch=batch)


def without_copies(docs: DataFrame, index_path: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Against an index that lasts, give the ``batch`` a name, so
    that a failed job can be run again."""
    docs, id_col = with_unique_ids(docs)
    return without(docs, id_col, deduplicate(docs, index_path, id_col=id_col, batch=batch).where("not kept").select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept",
                                    F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
           from documents)
select doc_id, first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256 order by size desc, doc_id
                    rows between unbounded preceding and unbounded following)
"""
