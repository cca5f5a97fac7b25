"""Session helpers.

On a cluster the session is handed in already configured; these helpers only
fill in what is missing (local runs, tests, the bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(cpus: int | None = None, shuffle_partitions: int | None = None,
              app: str = "veracity") -> SparkSession:
    """A local session for tests and the bench. The UI stays off."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    shuffle_partitions = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VERACITY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    ``spark.checkpoint.dir`` (session or context configuration) comes first, then a folder already
    set on the context in code. With neither, a local session gets a scratch folder of its own; on
    a cluster that would be one machine's disk, so it raises instead.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current is None:
        if not configured:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="veracity-ckpt-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return configured or current


def filter_joins_at_runtime(spark: SparkSession, reference_bytes: str = "1GB", scanned_bytes: str = "10GB", keys: int = 100_000_000) -> None:
    """Has Spark filter the large side of shuffle joins by a Bloom filter over the keys of the other side, where that side is filtered
    and at most ``reference_bytes`` and the large side's scans are at least ``scanned_bytes``. The loss-ratio check (J8) then
    drops claims of policies that the reference table lacks before they are grouped and shuffled. ``keys`` bounds the filter (about
    one byte a key)."""
    name = "spark.sql.optimizer.runtime.bloomFilter"
    for key, value in (("enabled", "true"), ("creationSideThreshold", reference_bytes), ("applicationSideScanSizeThreshold", scanned_bytes),
                       ("maxNumItems", str(keys)), ("maxNumBits", str(8 * keys))):
        spark.conf.set(f"{name}.{key}", value)
