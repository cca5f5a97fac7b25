"""Mixing overlapping sources to target weights, by a minimum-cost flow.

1. A document's size is its number of words. Documents are summed by the set of sources they belong to (pattern).
2. Targets: the sources share ``share`` times all words by weight; a target stops at ``most`` times its
   source's words, and what it can't take is shared again by weight among the others.
3. Flow: words go from patterns to their sources. Repeating costs: each further copy of a pattern's words is dearer than the one before, and a copy is
   cut into ``steps`` parts of rising cost, so the load spreads over patterns. As costs lie on the arcs out of the
   start alone, filling them from the cheapest to the dearest, each to a maximum flow, is the cheapest flow.
4. Selection: a pattern's documents lie on a line in seeded order, ``most`` copies one after the other, and each source takes
   its routed words from it. So each source gets its words exactly; one document at each border is taken in part.
   Places on the line are running totals over range partitions, so a pattern of any size spreads over tasks.

Only sums by pattern reach the driver, at most ``MOST_PATTERNS`` of them (more raise an error): the graph of sources and
patterns doesn't grow with the documents.

Defined results: a null or empty text has size 0 and nothing is taken of it. A null among a document's sources is
a source of its own, last in order; repeated names count once; a document without sources is never taken. A null id counts as an empty one in the
seeded order; rows with equal ids lie by size, then as stored. A source that overlaps may offer less than its target,
because others take its documents; it then gets what the largest flow gives. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.running import running_total
from veracity.llm.scratch import Staged, small_batches
from veracity.llm.words import Words, slices

MOST_PATTERNS = 100_000


@dataclass(frozen=True)
class Settings:
    """``share``: words of the mix by words there are; ``most``: how often a document may be taken; ``steps``: parts of
    rising cost a copy; ``seed``: of the order of documents."""
    share: float = 1.5
    most: int = 2
    steps: int = 4
    seed: str = "2024"


def three_one_two(place: int) -> float:
    """The weight of the source at this place, in code-point order."""
    return (3.0, 1.0, 2.0)[place % 3]


def targets(sizes: list[int], weights: list[float], total: float, most: int) -> list[float]:
    """``total`` shared by weight, none above ``most`` times its size, the excess shared again."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = total, math.fsum(weights)
    level = math.inf
    for i in order:
        if left / weight <= most * sizes[i] / weights[i]:
            level = left / weight
            break
        left -= most * sizes[i]
        weight -= weights[i]
    return [min(float(most * s), w * level) for s, w in zip(sizes, weights)]


class Network:
    """Arcs with capacities; maximum flows by blocking flows in layers (Dinic's method)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.free: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, capacity: int) -> int:
        for head, tail, c in ((a, b, capacity), (b, a, 0)):
            self.out[head].append(len(self.to))
            self.to.append(tail)
            self.free.append(c)
        return len(self.to) - 2

    def _layers(self, start: int, end: int) -> dict[int, int]:
        depth, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            for arc in self.out[node]:
                if self.free[arc] and self.to[arc] not in depth:
                    depth[self.to[arc]] = depth[node] + 1
                    queue.append(self.to[arc])
        return depth if end in depth else {}

    def fill(self, start: int, end: int) -> None:
        while depth := self._layers(start, end):
            tried: dict[int, int] = defaultdict(int)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    amount = min(self.free[a] for a in path)
                    for a in path:
                        self.free[a] -= amount
                        self.free[a ^ 1] += amount
                    path, node = [], start
                    continue
                arcs = self.out[node]
                while tried[node] < len(arcs) and not (self.free[arcs[tried[node]]] and depth.get(self.to[arcs[tried[node]]]) == depth[node] + 1):
                    tried[node] += 1
                if tried[node] < len(arcs):
                    path.append(arcs[tried[node]])
                    node = self.to[path[-1]]
                elif not path:
                    break
                else:
                    node = self.to[path.pop() ^ 1]
                    tried[node] += 1


def route(patterns: list[tuple[list[int], int]], quotas: list[int], most: int, steps: int) -> list[list[int]]:
    """Words routed from each pattern (its sources, its words) to each of its sources: of all largest
    flows that the quotas allow, one of least cost."""
    net, start, end = Network(), 0, 1
    source = [2 + i for i in range(len(quotas))]
    for s, q in zip(source, quotas):
        net.arc(s, end, q)
    entries, arcs = [], []
    for p, (members, words) in enumerate(patterns):
        node = 2 + len(quotas) + p
        entries.append(net.arc(start, node, 0))
        arcs.append([net.arc(node, source[s], most * words) for s in members])
    for step in range(most * steps):
        for (_, words), entry in zip(patterns, entries):
            net.free[entry] += words * (step + 1) // steps - words * step // steps
        net.fill(start, end)
        for entry in entries:
            net.free[entry] = 0       # what no quota wanted at this cost, none will want at a higher one
    return [[net.free[a ^ 1] for a in row] for row in arcs]


@dataclass(frozen=True)
class Source:
    name: str | None
    weight: float
    size: int
    target: float
    routed: int


@dataclass(frozen=True)
class Plan:
    """The sources in order; by pattern its number, its words and its routes (source, first word, end) on its line."""
    sources: list[Source]
    patterns: dict[str, tuple[int, int, list[tuple[int, int, int]]]]


def plan(sized: DataFrame, weigh: Callable[[int], float], settings: Settings) -> Plan:
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"sources overlap in more than {MOST_PATTERNS} ways")
    found = {r.pattern: (json.loads(r.pattern), r.words) for r in sorted(rows, key=lambda r: r.pattern)}
    names = sorted({n for members, _ in found.values() for n in members}, key=lambda n: (n is None, n or ""))
    at = {n: i for i, n in enumerate(names)}
    members = {p: sorted(at[n] for n in m) for p, (m, _) in found.items()}
    size = [0] * len(names)
    for p, (_, words) in found.items():
        for s in members[p]:
            size[s] += words
    weight = [weigh(i) for i in range(len(names))]
    total = settings.share * sum(w for p, (_, w) in found.items() if members[p])
    goal = targets(size, weight, total, settings.most) if names else []
    routed = route([(members[p], w) for p, (_, w) in found.items()], [math.floor(g + 0.5) for g in goal], settings.most, settings.steps)
    got, patterns = [0] * len(names), {}
    for n, ((p, (_, words)), flows) in enumerate(zip(found.items(), routed)):
        lines, begin = [], 0
        for s, flow in zip(members[p], flows):
            lines.append((s, begin, begin + flow))
            begin += flow
            got[s] += flow
        patterns[p] = (n, words, lines)
    return Plan([Source(*x) for x in zip(names, weight, size, goal, got)], patterns)


def sizes(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pattern (the sources as sorted JSON) and size of each document."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [Words(data, offsets).counts for _, _, data, offsets in slices(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("pattern"), pa.array(np.concatenate(parts), pa.int64())],
                    names=["doc_id", "pattern", "size"])

    small_batches(docs.sparkSession)
    named = F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.to_json(named).alias("pattern"), F.col(text_col).alias("text")) \
        .mapInArrow(count, "doc_id long, pattern string, size long")


def _taken(begin: Column, size: Column, line: Column, words: Column, most: int) -> Column:
    """Words of a document at ``begin`` that lie within a route, over all copies of the line."""
    out = F.lit(0).cast("long")
    for copy in range(most):
        at = begin + copy * words
        out = out + F.greatest(F.lit(0), F.least(line["to"], at + size) - F.greatest(line["begin"], at))
    return out


def mix(docs: DataFrame, sources: Column, weigh: Callable[[int], float] = three_one_two, settings: Settings = Settings(),
        id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """(doc_id, pattern, size, taken, shares: the words taken for each source) of each document, and the plan.
    ``sources``: an array of names; ``weigh``: the weight of a source by its place in code-point order."""
    spark = docs.sparkSession
    sized = Staged(sizes(docs, sources, id_col, text_col), "sizes").df
    made = plan(sized, weigh, settings)
    table = spark.createDataFrame(
        [(p, n, words, [(made.sources[s].name, a, b) for s, a, b in lines]) for p, (n, words, lines) in made.patterns.items()],
        "pattern string, number long, words long, lines array<struct<source:string,begin:long,to:long>>")
    place = F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 15)
    numbered = Staged(sized.join(F.broadcast(table.select("pattern", "number")), "pattern")      # MOST_PATTERNS rows at most
                      .select("doc_id", "size", "number", F.conv(place, 16, 10).cast("long").alias("place"),
                              F.monotonically_increasing_id().alias("row")), "numbered").df
    order = [F.col("place"), F.asc_nulls_last("doc_id"), F.col("size"), F.col("row")]
    on_line = running_total(numbered, "number", order, "size", "begin").join(F.broadcast(table), "number")
    shares = F.transform("lines", lambda x: F.struct(x["source"].alias("source"), _taken(
        F.col("begin"), F.col("size"), x, F.col("words"), settings.most).alias("taken")))
    taken = F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x["taken"])
    return on_line.withColumn("shares", shares).select("doc_id", "pattern", "size", taken.alias("taken"), "shares"), made


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken, made = mix(docs, F.array("source"))
    sources = spark.createDataFrame([(json.dumps([s.name], ensure_ascii=False), s.size, s.target) for s in made.sources],
                                    "name string, source_size long, target double")
    # the only source of a document, compared as text of one form on both sides
    name = F.from_json("name", "array<string>")[0]
    own = F.from_json("pattern", "array<string>")[0]
    sources = sources.select(name.alias("name"), "source_size", "target")
    return taken.join(F.broadcast(sources), own.eqNullSafe(F.col("name"))) \
        .select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last)) - 1 as place from d group by source),
w as (select *, (case place % 3 when 0 then 3 when 1 then 1 else 2 end)::double as weight from s),
r as (select *, 2 * source_size / weight as ratio from w),
o as (select *, ((select 1.5::double * sum(source_size) from s) - coalesce(sum(2 * source_size) over before, 0)) / sum(weight) over rest as level
      from r window before as (order by ratio, place rows between unbounded preceding and 1 preceding),
                    rest as (order by ratio, place rows between current row and unbounded following)),
l as (select first(level order by ratio, place) as level from o where level <= ratio),
t as (select source, source_size, least((2 * source_size)::double, weight * (select level from l)) as target from w),
p as (select doc_id, size, source_size, target, floor(target + 0.5)::bigint as quota,
             coalesce(sum(size) over (partition by t.source order by sha256('2024:' || doc_id)[1:15], doc_id
                                      rows between unbounded preceding and 1 preceding), 0) as begin
      from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
       (greatest(0, least(quota, begin + size) - begin)
        + greatest(0, least(quota, source_size + begin + size) - source_size - begin))::bigint as taken
from p
"""
