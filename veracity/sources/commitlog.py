"""A log of small JSON entries, one file each, that decides which written data count.

Data are written first, under a folder of their own; the entry that names them is created last, by one
exclusive file creation. So readers that start from the log see all of an entry's data or none, and
what a killed job has left behind is never read. The log has one entry a run or snapshot, not a row.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    """Entries of ``schema`` (DDL) with their ``number``, in the folder ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"number long, {schema}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(folder)

    def read(self) -> DataFrame:
        """All entries. A file that its writer didn't finish has no row."""
        return self.spark.read.schema(self.schema).json(self.path).where(F.col("number").isNotNull())

    def _next(self) -> int:
        numbers = [int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))
                   if s.getPath().getName().endswith(".json")]
        return max(numbers, default=0) + 1

    def append(self, entry: dict) -> int:
        """Adds ``entry`` and returns its number. Of two writers that want one number, the later takes the next."""
        number = self._next()
        while True:
            file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:08d}.json")
            try:
                out = self._fs.create(file, False)
            except Py4JJavaError:
                if not self._fs.exists(file):
                    raise
                number += 1
                continue
            out.write(bytearray((json.dumps({"number": number, **entry}) + "\n").encode()))
            out.close()
            return number
