"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only at minimisers: the word position, within each run of ``least`` consecutive
words, whose ``seed`` words hash smallest. Equal passages have minimisers at equal places, so a
passage of at least ``least`` words that occurs twice has suffixes in the array whose beginnings agree.

1. Suffixes whose first words (those that a repeat's suffix must share) occur once are dropped.
2. The rest are sorted by their next ``least`` words, then by the ``least - seed`` words before them, nearest
   first: range partitions, sorted within. No window whose minimiser they are goes further. Words are ordered
   by hash, which is as good an order as any. Contexts aren't written: range partitioning reads them twice.
3. Suffixes with the same first ``seed`` words follow each other. Two are compared, to the right by
   common prefix, then to the left: a match of at least ``least`` words gives the span of the maximal
   repeat around them, as far as their contexts go.
4. Of three or more, the one that agrees most in both directions need not be a neighbour, so all windows
   of ``least`` words around the minimiser are counted by hash. So they are where a group may go on in
   another partition or is larger than ``held``: then each partition gives each distinct window once,
   and they are counted together. Longer repeats are covered by their further minimisers.
5. Spans are merged for each document.

Every reported span is repeated word for word elsewhere (up to 32-bit hashes of all its words, and
64-bit hashes of these for windows), and every window of ``least`` words that occurs twice is within a
span: both occurrences have a suffix at its minimiser, and those are compared or counted.

The order ends with the place, so equal suffixes, a hot group of copies, spread over partitions.

Texts with one word sequence are taken together first, as in ``passages``.

Defined results: null counts as empty; texts below ``least`` words have no repeats; copies repeat each
other whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.passages import Settings as Anchors
from veracity.llm.passages import as_lists, merged, repeated_places, representatives, same_texts, scanned, with_texts
from veracity.llm.scratch import Staged, parallelism, small_batches
from veracity.llm.words import Words, mix64, slices

AT_ONCE = 1_000   # suffixes whose contexts become hashes together
_TURNS = mix64(np.arange(1, 4097, dtype=np.uint64))


@dataclass(frozen=True)
class Settings:
    least: int = 50   # words of a reported repeat
    seed: int = 20
    held: int = 20_000  # suffixes of one minimiser whose windows are counted at once

    @property
    def back(self) -> int:
        """Words before a minimiser that a window around it may have."""
        return self.least - self.seed


def contexts(texts: DataFrame, s: Settings) -> DataFrame:
    """(after, before, row, place) of the suffixes at the rows' places, with up to ``least`` words from there
    on and ``back`` words before as big-endian 32-bit hashes (``before`` nearest first)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(3)):
                words = Words(data, offsets)
                hashes = words.hashes()
                letters = (hashes >> np.uint64(32)).astype(">u4")
                wanted = batch.column(2).slice(lo, hi - lo).to_pylist()
                rows, places, after, before = [], [], [], []
                for i in same_texts(words, hashes, batch.column(1).slice(lo, hi - lo).to_pylist()):
                    a, b = words.first[i], words.first[i + 1]
                    row = batch.column(0)[lo + i].as_py()
                    for p in wanted[i]:
                        rows.append(row)
                        places.append(p)
                        after.append(letters[a + p:min(b, a + p + s.least)].tobytes())
                        before.append(letters[max(a, a + p - s.back):a + p][::-1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(after, pa.binary()), pa.array(before, pa.binary()),
                                                  pa.array(rows, pa.int64()), pa.array(places, pa.int32())],
                                                 ["after", "before", "row", "place"])
    return texts.mapInArrow(run, "after binary, before binary, row long, place int")


def common(x: bytes, y: bytes) -> int:
    """Words that two contexts share from their beginnings."""
    n = min(len(x), len(y)) // 4
    if x[:4 * n] == y[:4 * n]:
        return n
    return int((np.frombuffer(x, np.uint32, n) != np.frombuffer(y, np.uint32, n)).argmax())


def _spans(rows: list[tuple], s: Settings) -> list[tuple[int, int, int]]:
    """(row, start, end) from neighbours in a run of sorted (after, before, row, place)."""
    out = []
    for x, y in zip(rows, rows[1:]):
        ahead, back = common(x[0], y[0]), common(x[1], y[1])
        if ahead + back >= s.least:
            out += [(r[2], r[3] - back, r[3] + ahead) for r in (x, y)]
    return out


def window_hashes(after: list[bytes], before: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the hashes of the windows that start 0, 1, ... ``least - seed`` words before it, and
    which of them lie within the document."""
    left = s.back

    def sums(contexts: list[bytes], n: int, turn: int) -> np.ndarray:
        letters = np.frombuffer(b"".join([c[:4 * n].ljust(4 * n, b"\0") for c in contexts]), np.uint32).reshape(len(contexts), n)
        mixed = mix64(letters + _TURNS[turn:turn + n])
        return np.cumsum(np.concatenate([np.zeros((len(contexts), 1), np.uint64), mixed], axis=1), axis=1, dtype=np.uint64)
    ahead, back = sums(after, s.least, 0), sums(before, left, s.least)
    turns = np.arange(left + 1)
    within = (np.array([len(c) // 4 for c in after])[:, None] >= s.least - turns) \
        & (np.array([len(c) // 4 for c in before])[:, None] >= turns)
    return mix64(ahead[:, s.least - turns] + back[:, turns] + _TURNS[turns]), within


class Group:
    """Windows around the suffixes of one minimiser within a partition."""

    def __init__(self, s: Settings) -> None:
        self.s, self.size, self.parts, self.rows = s, 0, [], []

    def add(self, rows: list[tuple]) -> None:
        self.size += len(rows)
        self.rows += rows
        if len(self.rows) >= AT_ONCE:
            self.pack()

    def pack(self) -> None:
        """Contexts become hashes."""
        if self.rows:
            after, before, row, place = zip(*self.rows)
            windows, within = window_hashes(after, before, self.s)
            of, turn = np.nonzero(within)
            self.parts.append((windows[of, turn], np.array(row, np.int64)[of], (np.array(place, np.int64)[of] - turn).astype(np.int32)))
            self.rows = []

    def counted(self) -> tuple[np.ndarray, ...]:
        """Each window's hash, row, start, how often it is here, and whether it is the first of its hash."""
        self.pack()
        window, row, start = (np.concatenate(c) for c in zip(*self.parts))
        _, first, which, n = np.unique(window, return_index=True, return_inverse=True, return_counts=True)
        leads = np.zeros(len(window), bool)
        leads[first] = True
        return window, row, start, n[which], leads


def _spans_of(row: np.ndarray, start: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of windows, those that follow each other joined."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    last = np.append(new[1:], True)[:len(row)]
    return row[new], start[new], start[last] + np.int32(s.least)


_SPAN = "row long, start int, end int, seed long, window long"


def group_spans(sorted_rows: DataFrame, s: Settings) -> DataFrame:
    """Spans from pairs and windows within each partition (``end`` given), and the distinct windows of
    groups that may go on elsewhere, with row and start of one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seed, open_ = Group(s), None, True   # the first group may have begun elsewhere
        pair: list[tuple[int, int, int]] = []
        small = Group(s)
        names = ["row", "start", "end", "seed", "window"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

        def batch_of(*cells) -> pa.RecordBatch:
            n = len(cells[0])
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(cells, kinds)], names)

        def closed(elsewhere: bool) -> Iterator[pa.RecordBatch]:
            if not elsewhere and group.size < 3:
                pair.extend(_spans(group.rows, s))
                return
            if not elsewhere and group.size < AT_ONCE:   # equal windows are of one group
                small.add(group.rows)
            elif group.size:
                yield from settled(group, elsewhere)

        def settled(group: Group, elsewhere: bool) -> Iterator[pa.RecordBatch]:
            window, row, start, n, leads = group.counted()
            twice = n > 1
            if twice.any():
                yield batch_of(*_spans_of(row[twice], start[twice], s), None, None)
            if elsewhere and len(window):
                key = np.full(int(leads.sum()), int.from_bytes(hashlib.blake2b(seed, digest_size=8).digest(), "big", signed=True))
                yield batch_of(row[leads], start[leads], None, key, window[leads].view(np.int64))

        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            if not rows:
                continue
            for head, same in groupby(rows, lambda r: r[0][:4 * s.seed]):
                if seed is not None and head != seed:
                    yield from closed(open_)
                    group, open_ = Group(s), False
                seed = head
                same = list(same)
                if group.size + len(same) > s.held:   # the rest of a large group counts as elsewhere
                    yield from closed(True)
                    group, open_ = Group(s), True
                group.add(same)
            if pair:
                yield batch_of(*zip(*pair), None, None)
                pair.clear()
            if small.size >= AT_ONCE:
                yield from settled(small, False)
                small = Group(s)
        if small.size:
            yield from settled(small, False)
        yield from closed(True)
    return sorted_rows.mapInArrow(run, _SPAN)


def windows_across(found: DataFrame, s: Settings) -> DataFrame:
    """(row, start, end) of the windows that several partitions hold. A window comes once from each group
    of a partition, so a common one makes no large list."""
    open_ = found.where("window is not null")
    twice = open_.groupBy("seed", "window").agg(F.collect_list(F.struct("row", "start")).alias("places")).where("size(places) > 1")
    return twice.select(F.explode("places").alias("p")).select("p.row", "p.start", (F.col("p.start") + s.least).cast("int").alias("end"))


def repeats(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id, n_words, rep, copies), and (row, spans) of the texts with repeats: word
    borders [start, end, start, end, ...], merged. ``rep`` is the row that stands for all copies."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = Staged(scanned(docs, Anchors(s.least, s.seed)), "suffixes").df
    of_text, reps = representatives(rows)
    repeated = Staged(repeated_places(reps), "places")
    ordered = contexts(with_texts(docs, repeated.df), s).repartitionByRange(parallelism(spark), "after", "before", "row", "place") \
        .sortWithinPartitions("after", "before", "row", "place")
    found = Staged(group_spans(ordered, s), "spans")
    repeated.drop()

    spans = found.df.where("window is null").select("row", "start", "end").union(windows_across(found.df, s))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs in batch.column(1):
                out.append(merged(*(pairs.values.field(i).to_numpy() for i in (0, 1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(out, pa.int32())], ["row", "spans"])
    of_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("pairs")) \
        .mapInArrow(merge, "row long, spans array<int>")
    return rows.join(of_text, "digest").select("row", "doc_id", "n_words", "rep", "copies"), of_row


def summary(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_repeated (words within spans), spans (start-end of words, joined by commas)."""
    rows, spans = repeats(docs, s)
    starts, ends = (F.filter("spans", lambda _, i: i % 2 == 0), F.filter("spans", lambda _, i: i % 2 == 1))
    total = F.aggregate(ends, F.lit(0), lambda a, x: a + x) - F.aggregate(starts, F.lit(0), lambda a, x: a + x)
    shown = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                                     lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string"))), ",")
    spans = spans.select(F.col("row").alias("rep"), total.cast("long").alias("n"), shown.alias("shown"))
    copied = (F.col("copies") > 1) & (F.col("n_words") >= s.least)
    return rows.join(spans, "rep", "left").select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).alias("n_repeated"),
        F.when(copied, F.concat(F.lit("0-"), F.col("n_words").cast("string"))).otherwise(F.coalesce("shown", F.lit(""))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
