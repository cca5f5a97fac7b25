"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt by row into blocks; each cell of the grid holds one query block and
one candidate block. Within a cell, tiles of int8 products give cosines with a bound on the
quantisation error: for unit vectors u = û + e (û the dequantised int8 vector),

    |u·w - û·ŵ| <= |e||ŵ| + |û||f| + |e||f|

Pairs whose upper bound reaches the query's k-th best lower bound are recomputed in double precision
on the original vectors and merged by heaps. Cells give k rows a query; a window merges them. Every
candidate is looked at, so the result is exact.

Of equal vectors only the k+1 smallest ids are candidates (the window's group limit drops the rest
before the shuffle); no other can be among a query's k nearest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of another length are no candidates of a query; a row is never its own neighbour, other
rows of the same id and vector are; equal scores go to the smaller id; with fewer than k candidates
all are returned; queries without candidates give no rows; null ids are never queries and come last
among equals; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.llm.scratch import Staged, ship_package

TILE = 2048
MANY = 1 << 16  # pairs recomputed at once


class Block:
    """Vectors of one length, quantised."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / self.norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.int8 = np.rint(unit / self.scale[:, None]).astype(np.int8)
        whole = self.int8 * self.scale[:, None]
        self.size = np.sqrt((whole * whole).sum(axis=1))
        rest = unit - whole
        self.error = np.sqrt((rest * rest).sum(axis=1))

    def tile(self, lo: int) -> slice:
        return slice(lo, lo + TILE)


def bounds(q: Block, a: slice, c: Block, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Cosines from int8 products, and the bound on their error. The products are summed as floats,
    exactly: single ones hold integers to 2**24, doubles to 2**53."""
    kind = np.float32 if q.int8.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dots = (q.int8[a].astype(kind) @ c.int8[b].astype(kind).T).astype(np.float64)
    near = dots * q.scale[a][:, None] * c.scale[b][None, :]
    off = q.error[a][:, None] * (c.size[b] + c.error[b])[None, :] + q.size[a][:, None] * c.error[b][None, :] + 1e-12
    return near, off


def search_block(q: Block, c: Block, k: int) -> list[tuple[int, list[tuple[float, int, int]]]]:
    """For each query of the block: its number and its k best (score, -id, candidate's number)."""
    heaps: list[list] = [[] for _ in q.ids]
    worst = np.full(len(q.ids), -np.inf)
    for a in map(q.tile, range(0, len(q.ids), TILE)):
        for b in map(c.tile, range(0, len(c.ids), TILE)):
            near, off = bounds(q, a, c, b)
            low = near - off
            low[q.rows[a][:, None] == c.rows[b][None, :]] = -np.inf
            if low.shape[1] > k:
                kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            else:
                kth = np.full(low.shape[0], -np.inf)
            least = np.maximum(kth, worst[a])
            alive = (near + off >= least[:, None]) & (low > -np.inf)
            qi, cj = np.nonzero(alive)
            qi, cj = qi + a.start, cj + b.start
            for at in range(0, len(qi), MANY):
                x, y = qi[at:at + MANY], cj[at:at + MANY]
                score = (q.vectors[x] * c.vectors[y]).sum(axis=1) / (q.norms[x] * c.norms[y])
                for i, j, s in zip(x.tolist(), y.tolist(), score.tolist()):
                    heap, item = heaps[i], (s, -int(c.ids[j]), -j)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
            for i in np.unique(qi).tolist():
                if len(heaps[i]) == k:
                    worst[i] = heaps[i][0][0]
    return [(i, h) for i, h in enumerate(heaps) if h]


def _blocks(table: pa.Table) -> dict[int, Block]:
    """The table's vectors by length."""
    column = table.column("vector").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ids, rows = (table.column(n).to_numpy() for n in ("vec_id", "row"))
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = Block(ids[at], rows[at], flat[starts[at][:, None] + np.arange(n)].astype(np.float64))
    return out


# Stands for a null id, last among equals.
NO_ID = (1 << 63) - 1


def neighbours(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               query_block: int = 2048, candidate_block: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row that ``is_query`` (a condition on the
    id, named ``vec_id``) holds for."""
    ship_package(vectors.sparkSession)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = Staged(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                       F.monotonically_increasing_id().alias("row"))
        .where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite)
        .where(F.exists("vector", lambda x: x != 0.0)), "vectors").df
    queries = usable.where(F.coalesce(is_query, F.lit(False)))
    of_vector = Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id"), "row")
    candidates = usable.withColumn("n", F.row_number().over(of_vector)).where(f"n <= {k + 1}").drop("n") \
        .withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    q_blocks = max(1, -(-queries.count() // query_block))
    c_blocks = max(1, -(-usable.count() // candidate_block))

    def spread(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {n: [] for n in ("query_row", "query_id", "vec_id", "at", "score")}
        theirs = _blocks(right) if right.num_rows else {}
        for n, q in (_blocks(left) if left.num_rows else {}).items():
            if n not in theirs:
                continue
            c = theirs[n]
            for i, heap in search_block(q, c, k):
                for score, _, j in heap:
                    for name, v in zip(found, (q.rows[i], q.ids[i], c.ids[-j], c.rows[-j], score)):
                        found[name].append(v)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(found.items(), kinds)})

    pairs = spread(queries, "qb", q_blocks, "cb", c_blocks).groupBy("qb", "cb").cogroup(
        spread(candidates, "cb", c_blocks, "qb", q_blocks).groupBy("qb", "cb")).applyInArrow(
        cell, "query_row long, query_id long, vec_id long, at long, score double")
    # written, k rows a query and cell: a query that needs no column of it, such as a count, would have
    # the optimiser drop the columns that the function reads
    pairs = Staged(pairs, "neighbours").df
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "at")
    return pairs.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}") \
        .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select vec_id, case when len(embedding) > 0 and list_count(embedding) = len(embedding) then embedding::double[] end as e
  from embeddings),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v
      where e is not null and isfinite(list_dot_product(e, e)) and list_dot_product(e, e) > 0),
p as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) as score
      from n q join n c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank,
             vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
