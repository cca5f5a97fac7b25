"""Written intermediates in the shared checkpoint folder: they cut lineage, survive lost executors
and let later steps read only the columns they need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.session import checkpoint_dir


def new_path(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/veracity-scratch/{what}-{uuid.uuid4().hex}"


class Staged:
    """A DataFrame written once as Parquet; ``df`` reads it back, ``drop()`` deletes the files.

    Hashes, which most of these tables hold, don't compress, and codecs take memory beside the heap, so
    pages are only dictionary- and run-length-encoded unless ``compression`` says otherwise."""

    def __init__(self, df: DataFrame, what: str, compression: str = "none") -> None:
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, what)
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever the driver found it: a zip of its
    modules goes out with ``addPyFile``, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_veracity_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="veracity-package-")) / "veracity_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._veracity_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Ships the package, and has texts go to Python in batches of at most ``BATCH_ROWS`` rows (and Spark's byte limit), which
    bounds what a worker and the executor's buffers hold. A lower setting stays."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


ROW_ID = "__veracity_row_id"
BROADCAST_IDS = 1_000_000


def with_unique_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that names each row: ``doc_id`` where it is unique and never null, else
    a number written with the rows."""
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1)
    if not odd.count():
        return docs, "doc_id"
    return Staged(docs.withColumn(ROW_ID, F.monotonically_increasing_id()), "rows", "snappy").df, ROW_ID


def without(docs: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped`` (one column, long). Ids are broadcast up to
    ``BROADCAST_IDS`` of them, else both sides are shuffled."""
    gone = "__veracity_gone"
    ids = Staged(dropped.toDF(gone), "dropped").df
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    kept = docs.join(ids, docs[id_col].cast("long") == F.col(gone), "left_anti")
    return kept.drop(ROW_ID) if id_col == ROW_ID else kept


HOT = 1024


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``counted``: one row a key, ``n`` the number of its rows. Keys with
    more than 1/``HOT`` of all rows, fewer than ``HOT`` of them, are broadcast, so their rows stay where
    they are; the others are shuffled. Both inputs are read twice and should be written tables."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counted.where(F.col("n") > total / HOT).drop("n"))
    cold = counted.where(F.col("n") <= total / HOT).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))
