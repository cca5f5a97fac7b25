"""Importance resampling towards a target text collection, by hashed n-gram features.

1. Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Features are all runs of
   ``least`` to ``most`` words joined by one space; a feature's bucket is its CRC-32 modulo ``buckets``, taken of
   all features of a slice at once (``crc``).
2. Features are counted by bucket over all documents and over all target texts: each task gives one count a
   bucket. A bucket's gain is the smoothed log ratio of its two shares, in thousandths, rounded down. The gains,
   ``buckets`` numbers whatever the data, go to the driver and out with the second pass.
3. A document's weight is the sum of its features' gains. Gumbel noise from a hash of seed and id makes the
   highest scores a sample without replacement, the same in every run.
4. Of the documents with at least ``least_words`` words, the best ``percent`` per cent are drawn. Ranks are running
   counts over range partitions of the scores, so no task holds more than its share of rows.

Texts are read twice instead of keeping the features of all documents on disk.

Defined results: null, empty and wordless texts have no features, weight 0 and a score of noise alone. A null id
counts as an empty one in the noise and comes last among equal scores; rows with equal ids and scores are ranked by
features, then as stored. A text of any length is taken whole; memory is bounded by the slice or by one text. With
no target texts (or no documents) the counts on that side are zero and smoothing alone remains. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.crc import crc32, runs
from veracity.llm.running import running_total
from veracity.llm.scratch import Staged, small_batches, with_unique_ids
from veracity.llm.words import slices


@dataclass(frozen=True)
class Settings:
    """``least`` to ``most``: words a feature; ``percent`` of the documents with ``least_words`` words are drawn."""
    least: int = 1
    most: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: words a text, features a text, and the buckets of all features, text by text."""
    inside = _INSIDE[data]
    starts, ends, first = runs(inside, offsets)
    words = np.diff(first)
    # each word once, followed by one space wherever something other than a word followed
    keep = inside.copy()
    keep[1:] |= inside[:-1] & ~inside[1:]
    place = np.cumsum(keep) - 1
    text = np.where(inside, _LOWER[data], np.uint8(0x20))[keep]
    if len(starts):
        starts, ends = place[starts], place[ends - 1] + 1
    left = np.repeat(first[1:], words) - np.arange(len(starts))      # words to the end of the text, with this one
    counts, found, owners = np.zeros(len(words), np.int64), [], []
    owner = np.repeat(np.arange(len(words)), words)
    for k in range(settings.least, settings.most + 1):
        at = np.flatnonzero(left >= k)
        counts += np.maximum(words - k + 1, 0)
        found.append(crc32(text, starts[at], ends[at + k - 1]) % np.uint32(settings.buckets))
        owners.append(owner[at])
    buckets = np.concatenate(found).astype(np.int64)
    if settings.most > settings.least:
        buckets = buckets[np.argsort(np.concatenate(owners), kind="stable")]
    return words, counts, buckets


def bucket_counts(texts: DataFrame, settings: Settings, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                n += np.bincount(features(data, offsets, settings)[2], minlength=settings.buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()       # at most ``buckets`` rows
    out = np.zeros(settings.buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of target share to source share, in thousandths, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in slices(batch.column("text")):
                words, counts, buckets = features(data, offsets, settings)
                total = np.append(0, np.cumsum(gain[buckets]))
                end = np.cumsum(counts)
                out.append((words, counts, total[end] - total[end - counts]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*out))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str) -> F.Column:
    """Gumbel noise of a document, in thousandths, rounded down."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(named, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score and rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, settings, text_col), bucket_counts(target, settings, text_col))
    scored = Staged(weights(docs, gain, settings, id_col, text_col).select(
        "*", (F.col("weight") + noise(settings.seed)).alias("score"),
        F.when(F.col("n_words") >= settings.least_words, 0).otherwise(1).cast("long").alias("out"),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row")), "scores").df
    n = scored.where("out = 0").count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight"), F.col("row")]
    placed = running_total(scored, "out", order, "one", "place")
    drawn = (F.col("out") == 0) & (F.col("place") < settings.percent * n // 100)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(drawn, F.col("place") + 1).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The drawn documents with their own columns."""
    from veracity.llm.scratch import ROW_ID
    docs, id_col = with_unique_ids(docs)
    ids = resample(docs, target, settings, id_col).where("rank is not null").select(F.col("doc_id").alias("__drawn"))
    kept = docs.join(ids, docs[id_col].cast("long") == F.col("__drawn"), "left_semi")
    return kept.drop(ROW_ID) if id_col == ROW_ID else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a byte string x, given in hexadecimal, with the table ``t`` made by rule.
CRC_TABLE = """
crc_bits(i, k, v) as (
  select i::ubigint, 0, i::ubigint from range(256) r(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from crc_bits where k < 8),
crc_table as (select list(v order by i) as t from crc_bits where k = 8)"""
CRC = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
    list_transform(range(0, (length(x) / 2)::bigint), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::ubigint)),
    lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::bigint])))"""

SQL = rf"""
with recursive {CRC_TABLE},
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
dw as (select doc_id, w, count(*) as n from (select doc_id, unnest(words) as w from d) group by all),
bw as (select w, count(*) as n from (select unnest(words) as w from b) group by all),
hashed as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
bucket as (select w, {CRC} % 10000 as k from hashed, crc_table),
s as (select k, sum(n) as s from dw join bucket using (w) group by k),
t as (select k, sum(n) as t from bw join bucket using (w) group by k),
sums as (select (select coalesce(sum(n), 0) from dw)::double as s_all, (select coalesce(sum(n), 0) from bw)::double as t_all),
gain as (select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as g
         from s left join t using (k), sums),
weight as (select doc_id, sum(n * g)::bigint as weight from dw join bucket using (w) join gain using (k) group by doc_id),
h as (select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
             ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h from d left join weight using (doc_id)),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from h),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank
from scored left join ranked using (doc_id)
"""
