"""Running totals over an ordered table that no single task could hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from veracity.llm.scratch import Staged, parallelism, ship_package


def running_total(df: DataFrame, group: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (long) over the rows of the same ``group`` (long, never null) that come
    before in ``order``, which must tell all rows apart or leave only equal ones together.

    Rows are range-partitioned by group and order, so a group may spread over any number of tasks; each task
    sums its own rows, and the sums of earlier tasks, at most one row a task and group border, are broadcast.
    ``df`` is read twice and should be a written table."""
    ship_package(df.sparkSession)
    names = df.columns
    schema = StructType(df.schema.fields[:]).add(out, LongType()).add("__part", IntegerType())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, current, base = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = batch.column(group).to_numpy(), batch.column(value).to_numpy()
            before = done + np.cumsum(values) - values
            head = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            bases = before[head]
            if groups[0] == current:
                bases[0] = base
            totals = before - np.repeat(bases, np.diff(np.append(head, len(groups))))
            done, current, base = int(before[-1] + values[-1]), groups[-1], bases[-1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(totals, pa.int64()), pa.array(np.full(len(groups), part, np.int32))],
                names=[*names, out, "__part"])

    sorted_rows = df.repartitionByRange(parallelism(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    parts = Staged(sorted_rows.mapInArrow(sums, schema), "running").df
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums_before = parts.groupBy(group, "__part").agg(F.sum(value).alias("s")) \
        .select(group, "__part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__earlier"))
    return parts.join(F.broadcast(sums_before), [group, "__part"]) \
        .select(*(n for n in names), (F.col(out) + F.col("__earlier")).alias(out))
