"""Exact substring deduplication by seed and extend.

A window is ``window`` consecutive words of one document; a window is repeated if its word sequence
starts anywhere else, in the same document or another. Every word that a repeated window covers is
removed, judged on the input.

1. Seeds: within each window the smallest hash of ``seed`` consecutive words is its anchor
   (winnowing), so equal windows have equal anchors at equal places. Documents are joined on anchors;
   anchors that occur once are dropped.
2. Extension: from each repeated anchor the match is extended to both sides, to every window that the
   anchor stands for. Occurrences aren't compared in pairs. Those that agree as far as all these
   windows reach form a class, and are repeated whole if it has two. One of each class is compared
   with the other classes by its windows' hashes, which tell how far to the left and right they agree.
3. Neighbouring repeated windows are joined to maximal repeats.

Texts with one word sequence are taken together first: each of two or more copies of at least a
window's length is removed whole, and one of them stands for all in the steps above. Counting
pre-aggregates before the shuffle; on the way back from counts to places only repeated hashes move.

Defined results: null counts as empty; texts shorter than a window keep all words; a document that
loses all words has the hash of the empty text; repeated rows are copies of each other; an empty table
gives no rows; other columns are ignored (``without_repeats`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from veracity.llm.scratch import Staged, join_counted, small_batches
from veracity.llm.words import Words, grams, mix64, prefix_hash, slices

BROADCAST_ROWS = 500_000   # documents whose places are broadcast; beyond that texts are shuffled
BROADCAST_PLACES = 8_000_000
_TURNS = mix64(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
KEYS = ("row", "doc_id", "text_hash", "digest")
_DIGEST, _KEPT = "__text_digest", "__kept_text"


@dataclass(frozen=True)
class Settings:
    window: int = 35
    seed: int = 12


def anchors(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the word number of each one's anchor, and the hash of each seed."""
    seeds = grams(hashes, s.seed)
    span = s.window - s.seed + 1
    if len(seeds) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), seeds
    per = np.maximum(counts - s.window + 1, 0)
    starts = np.arange(per.sum()) + np.repeat(first[:-1] - (np.cumsum(per) - per), per)
    if not len(starts):
        return starts, starts, seeds
    least = np.lib.stride_tricks.sliding_window_view(seeds, span)[starts].argmin(axis=1) \
        if len(starts) * 4 < len(seeds) else np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(axis=1)[starts]
    return starts, starts + least, seeds


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a word sequence."""
    return prefix_hash(hashes).tobytes() + prefix_hash(mix64(hashes ^ np.uint64(0xA0761D6478BD642F))).tobytes()


def joined(words: Words, raw: bytes, doc: int, covered: np.ndarray | None = None) -> bytes:
    """The words of a document that aren't covered, joined by one space."""
    a, b = words.first[doc], words.first[doc + 1]
    starts, ends = words.starts[a:b], words.ends[a:b]
    if covered is not None:
        starts, ends = starts[~covered], ends[~covered]
    return b" ".join([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist())])


def as_lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)).cast(kind))


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges joined: [start, end, start, end, ...]."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return np.stack([a[new], b[np.append(new[1:], len(a)) - 1]], axis=1).ravel()


def scanned(docs: DataFrame, s: Settings) -> DataFrame:
    """For each row: row, doc_id, text_hash, digest, n_words, whole_sha256 and its distinct anchors (hash, word)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                words, raw = Words(data, offsets), data.tobytes()
                hashes = words.hashes()
                _, at, seeds = anchors(hashes, words.counts, words.first, s)
                at = np.unique(at)
                cut = np.searchsorted(at, words.first)
                found = [at[x:y] for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1, 3)),
                     pa.array([digest(hashes[x:y]) for x, y in zip(words.first, words.first[1:])], pa.binary()),
                     pa.array(words.counts.astype(np.int64)),
                     pa.array([hashlib.sha256(joined(words, raw, i)).hexdigest() for i in range(hi - lo)], pa.string()),
                     as_lists([seeds[f].astype(np.int64) for f in found], pa.int64()),
                     as_lists([f - words.first[i] for i, f in enumerate(found)], pa.int32())],
                    ["doc_id", "row", "text_hash", "digest", "n_words", "whole_sha256", "hashes", "places"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text",
                       F.xxhash64("text").alias("text_hash")) \
        .mapInArrow(run, "doc_id long, row long, text_hash long, digest binary, n_words long, whole_sha256 string, "
                         "hashes array<long>, places array<int>")


def with_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (row, doc_id, text_hash, digest, places) with the text of their documents. Rows that share
    an id, or have none, meet those of their own text alone; the digest decides, see ``same_texts``."""
    size = places.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_PLACES:
        places = F.broadcast(places)
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text").join(
        places, F.col("id").eqNullSafe(places["doc_id"]) & (F.col("hash") == places["text_hash"])) \
        .select("row", "digest", "places", "text")


def same_texts(words: Words, hashes: np.ndarray, wanted: list[bytes]) -> Iterator[int]:
    """Documents of a slice whose words are the ones looked for."""
    for i, d in enumerate(wanted):
        if digest(hashes[words.first[i]:words.first[i + 1]]) == d:
            yield i


def extended(texts: DataFrame, s: Settings, with_windows: bool) -> DataFrame:
    """(anchor, context, row, place, first, k) and, ``with_windows``, their hashes: for each of the row's
    ``places``, the ``k`` windows that have their anchor there, a run of starts from ``first``, and one hash
    for all of them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(3)):
                words = Words(data, offsets)
                hashes = words.hashes()
                starts, at, seeds = anchors(hashes, words.counts, words.first, s)
                repeated = np.zeros(len(words) + 1, bool)
                places = batch.column(2).slice(lo, hi - lo).to_pylist()
                for i in same_texts(words, hashes, batch.column(1).slice(lo, hi - lo).to_pylist()):
                    repeated[words.first[i] + np.array(places[i], np.int64)] = True
                pick = repeated[at]
                starts, at = starts[pick], at[pick]
                new = np.flatnonzero(np.diff(at, prepend=-1))   # windows of one anchor follow each other
                windows = grams(hashes, s.window)[starts] if len(starts) else np.empty(0, np.uint64)
                size = np.diff(np.append(new, len(starts)))
                turn = np.arange(len(starts)) - np.repeat(new, size)
                context = mix64(np.add.reduceat(windows * _TURNS[turn], new) + size.astype(np.uint64)) if len(new) else windows
                doc = np.searchsorted(words.first, starts[new], "right") - 1
                rows = batch.column(0).slice(lo, hi - lo).to_numpy()
                cells = {"anchor": pa.array(seeds[at[new]].astype(np.int64)), "context": pa.array(context.astype(np.int64)),
                         "row": pa.array(rows[doc]), "place": pa.array((at[new] - words.first[doc]).astype(np.int32)),
                         "first": pa.array((starts[new] - words.first[doc]).astype(np.int32)), "k": pa.array(size.astype(np.int32))}
                if with_windows:
                    cells["windows"] = pa.ListArray.from_arrays(pa.array(np.append(new, len(starts)).astype(np.int32)),
                                                                pa.array(windows.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(cells)
    kinds = "anchor long, context long, row long, place int, first int, k int"
    return texts.mapInArrow(run, kinds + ", windows array<long>" * with_windows)


def representatives(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``scanned`` rows: (digest, rep, copies) of each text, and the rows that stand for all."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    of_text = Staged(rows.groupBy("digest").agg(first.alias("f"), F.count("*").alias("copies"))
                     .select("digest", F.col("f.row").alias("rep"), "copies"), "texts").df
    return of_text, rows.join(of_text.select(F.col("rep").alias("row")), "row", "left_semi")


def repeated_places(reps: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, digest, places) with the places whose anchor hash occurs at other places too."""
    placed = reps.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("a")) \
        .select("row", F.col("a.hashes").alias("anchor"), F.col("a.places").alias("place"))
    again = Staged(placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors").df
    places = join_counted(placed, again, ["anchor"]).groupBy("row").agg(F.collect_list("place").alias("places"))
    return places.join(reps.select(*KEYS), "row").select(*KEYS, "places")


def repeats(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """All rows (as ``scanned``, with representative and copies) and, for representatives with
    repeated windows, their maximal repeats as (row, doc_id, text_hash, digest, places): word borders
    [start, end, start, end, ...]."""
    small_batches(docs.sparkSession)
    rows = Staged(scanned(docs, s), "anchors").df
    of_text, reps = representatives(rows)
    seeds = Staged(repeated_places(reps), "seeds")

    ids_repeat = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0

    def occurrences(wanted: DataFrame, with_windows: bool) -> DataFrame:
        found = extended(with_texts(docs, wanted), s, with_windows)
        return found.distinct() if ids_repeat else found  # a repeated row meets its places once each
    places = Staged(occurrences(seeds.df, False), "contexts")
    seeds.drop()
    # occurrences that agree on all windows of the anchor: one of them stands for its class
    stand = Staged(places.df.groupBy("anchor", "context").agg(F.min(F.struct("row", "place")).alias("rep"), F.count("*").alias("n"))
                   .select("anchor", "context", "n", "rep.row", "rep.place"), "classes")
    # classes are compared where an anchor has several: only their windows are looked at
    several = Staged(stand.df.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    wanted = join_counted(stand.df.select("anchor", "row", "place"), several.df, ["anchor"]) \
        .groupBy("row").agg(F.collect_list("place").alias("places"))
    wanted = Staged(wanted.join(reps.select(*KEYS), "row").select(*KEYS, "places"), "wanted")
    shown = Staged(occurrences(wanted.df, True), "windows")
    equal = Staged(shown.df.select("anchor", F.explode("windows").alias("window")).groupBy("anchor", "window")
                   .agg(F.count("*").alias("n")).where("n > 1"), "equal")
    # all windows of a class of two and more are repeated; of a class of one, those that other classes hold
    whole = join_counted(places.df.select("anchor", "context", "row", "first", "k"),
                         stand.df.where("n > 1").select("anchor", "context", "n"), ["anchor", "context"])
    some = join_counted(shown.df.select("anchor", "row", "first", F.posexplode("windows").alias("turn", "window")),
                        equal.df, ["anchor", "window"])
    found = whole.select("row", "first", "k").unionByName(
        some.select("row", (F.col("first") + F.col("turn")).alias("first"), F.lit(1).alias("k"))) \
        .groupBy("row").agg(F.collect_list(F.struct("first", "k")).alias("runs"))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1):
                first, k = (runs.values.field(i).to_numpy() for i in (0, 1))
                out.append(merged(first, first + k - 1 + s.window))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(out, pa.int32())], ["row", "places"])
    spans = found.mapInArrow(merge, "row long, places array<int>").join(reps.select(*KEYS), "row")
    spans = Staged(spans.select(*KEYS, "places"), "repeats").df
    for table in (places, stand, several, wanted, shown, equal):
        table.drop()
    return rows.drop("hashes", "places").join(of_text, "digest"), spans


def _kept(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """(row, n_removed, kept_sha256 or the kept text) of the representatives with repeats."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(3)):
                words, raw = Words(data, offsets), data.tobytes()
                places = batch.column(2).slice(lo, hi - lo).to_pylist()
                rows, removed, out = [], [], []
                for i in same_texts(words, words.hashes(), batch.column(1).slice(lo, hi - lo).to_pylist()):
                    covered = np.zeros(words.counts[i], bool)
                    for a, b in zip(places[i][::2], places[i][1::2]):
                        covered[a:b] = True
                    rows.append(batch.column(0)[lo + i].as_py())
                    removed.append(int(covered.sum()))
                    text = joined(words, raw, i, covered)
                    out.append(text.decode() if with_text else hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(out, pa.string())], ["row", "n_removed", "kept"])
    return with_texts(docs, spans).mapInArrow(run, "row long, n_removed long, kept string").dropDuplicates(["row"])


def summary(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows, spans = repeats(docs, s)
    kept = _kept(docs, spans, with_text=False).withColumnRenamed("row", "rep")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= s.window)
    return rows.join(kept, "rep", "left").select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole_sha256")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with its own columns; texts that hold repeats are replaced by their kept words, and
    ``n_chars`` follows where it exists. Rows with null or untouched texts stay as they are."""
    rows, spans = repeats(docs, s)
    kept = _kept(docs, spans, with_text=True).withColumnRenamed("row", "rep")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= s.window)
    change = rows.join(kept, "rep", "left").where(copied | F.col("kept").isNotNull()) \
        .groupBy("digest").agg(F.first(F.when(copied, F.lit("")).otherwise(F.col("kept"))).alias(_KEPT))
    change = Staged(change.withColumnRenamed("digest", _DIGEST), "changes", "snappy").df

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in slices(batch.column(at)):
                words = Words(data, offsets)
                hashes = words.hashes()
                found += [digest(hashes[x:y]) for x, y in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, _DIGEST])
    at = docs.columns.index("text")
    out = docs.mapInArrow(run, StructType(docs.schema.fields + [StructField(_DIGEST, BinaryType())])).join(change, _DIGEST, "left")
    new = {"text": F.coalesce(_KEPT, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(_KEPT).isNotNull(), F.length(_KEPT).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
