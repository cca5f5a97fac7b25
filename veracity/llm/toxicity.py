"""Toxicity scores from a weighted lexicon.

Texts are folded (case, accents, look-alike letters of other scripts, digits and signs that stand for
letters). Lexicon words, lexicon stems (which match at the start of a word) and exception phrases are
found in one Aho-Corasick pass. The heaviest entry at each word counts, none within an exception
phrase, and the summed weights are normalised by the square root of the text's length in words.

Learning: from a bounded sample of labelled rows (``Settings.sample`` of each class, by hash order).
Weights of words and stems are smoothed log odds of occurring in a toxic against a clean text, over distinct
texts, so that copies count once. Words of the fixed seed list take part even where no labels exist.
Exception phrases are pairs of neighbouring words with a lexicon word that the sample shows mostly in
clean texts. The score is x / (x + t), where x is the normalised sum and t the cut between the
classes in the sample. Where a class has more labelled rows than the sample takes, its rows count for as
many as they stand for, so that the precision of entries, exceptions and the cut keep the labels' ratio.

Defined results: null counts as empty; an empty text scores 0; whole texts of any length are scanned;
every row gives one row; labels of null or unknown documents are ignored; several labels of one
document count as their maximum; an empty or missing label table leaves the seed list; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.scratch import small_batches

# Words of insult, the prior of the lexicon.
SEED = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown",
        "imbecile", "dumbass", "asshole", "bastard", "bitch", "jerk", "retard")
# Harmless phrases with such words.
SEED_EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "stupid question", "circus clown")
# Letters of other scripts that look like Latin ones, and digits read as letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһкмнтвѵԛԝαεικνορτυχγ", "aeopcyxijsdhkmhtbvqwaeikvoptuxy"))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = {"@": "a", "$": "s", "!": "i"}


def _folds() -> dict[int, str]:
    table = {ord(c): v for c, v in {**LOOK_ALIKES, **DIGITS}.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code)).lower()[:1]
        if base.isascii() and base.isalpha():
            table[code] = base
    table |= {code: None for code in [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]}
    return table


_FOLDS = _folds()
_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower().translate(_FOLDS)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000      # labelled rows of each class that are learned from, at most
    lexicon: int = 5_000      # learned words and stems, at most
    stems: tuple[int, ...] = (4, 5, 6)  # lengths of learned stems
    least_share: float = 0.02  # of the toxic texts that hold a learned entry
    least_texts: int = 5
    least_odds: float = 1.5   # log odds of a learned entry
    least_precision: float = 0.4  # toxic ones among the texts with a learned entry
    prior: float = 2.0        # toxic texts that each seed word counts as seen in


@dataclass
class Lexicon:
    """``weights`` by folded word, or stem with ``*`` behind; ``exceptions`` as folded phrases; ``cut``:
    the x that scores 0.5."""
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    cut: float = 1.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self.cut = lexicon.cut
        self.auto = ahocorasick.Automaton()
        entries: dict[str, list] = {}  # [length, weight of the whole word, of the stem, an exception]
        for w, weight in lexicon.weights.items():
            e = entries.setdefault(w.rstrip("*"), [len(w.rstrip("*")), 0.0, 0.0, False])
            e[2 if w.endswith("*") else 1] = weight
        for p in lexicon.exceptions:
            entries.setdefault(p, [len(p), 0.0, 0.0, False])[3] = True
        for w, e in entries.items():
            self.auto.add_word(w, tuple(e))
        self.auto.make_automaton()
        self.any = bool(entries)

    def sum(self, text: str) -> float:
        """Summed weights in a folded text."""
        if not self.any or not text:
            return 0.0
        n, found, spared = len(text), {}, []
        for end, (size, whole, stem, exception) in self.auto.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            inside = end + 1 < n and text[end + 1].isalnum()
            weight = stem if inside else max(whole, stem)
            if weight > found.get(start, 0.0):
                found[start] = weight
            if exception and not inside:
                spared.append((start, end))
        if spared:
            return sum(w for a, w in found.items() if not any(x <= a <= y for x, y in spared))
        return sum(found.values())

    def x(self, text: str | None) -> float:
        """The sum normalised by length."""
        total = self.sum(fold(text or ""))
        return total / math.sqrt(20 + len(text.split())) if total > 0 else 0.0

    def score(self, text: str | None) -> float:
        x = self.x(text)
        return x / (x + self.cut)


def held_out(id_col: F.Column) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that may be learned from."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_weights(labels: DataFrame, settings: Settings) -> tuple[float, float]:
    """How many labelled rows a clean and a toxic row of the sample stand for."""
    totals = {r.toxic: r.n for r in learning_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return tuple(max(1.0, totals.get(c, 0) / settings.sample) for c in (0, 1))


def sample_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of the learning sample. The sample's ids are at most 2 * ``sample`` rows, so they
    are broadcast and no text is shuffled."""
    of = learning_labels(labels)
    order = F.xxhash64("doc_id")
    picked = of.where("toxic = 1").orderBy(order, "doc_id").limit(settings.sample).unionByName(
        of.where("toxic = 0").orderBy(order, "doc_id").limit(settings.sample))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id") \
        .select("text", "toxic")


def _counted(sample: DataFrame, units) -> DataFrame:
    """(unit, toxic texts, clean texts), over distinct texts of each class."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(units(fold(text or "")))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                 pa.array([clean[k] for k in keys], pa.int64())], ["unit", "a", "b"])
    return sample.mapInArrow(run, "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _entries(stems: tuple[int, ...]):
    def of(text: str) -> set[str]:
        words = set(_WORD.findall(text))
        return {w for w in words if 2 <= len(w) <= 40} | {w[:k] + "*" for w in words for k in stems if len(w) > k}
    return of


def fit(docs: DataFrame, labels: DataFrame | None, settings: Settings = Settings()) -> Lexicon:
    seeds = {fold(w) for w in SEED}
    exceptions = [fold(p) for p in SEED_EXCEPTIONS]
    if labels is None:
        return Lexicon(dict.fromkeys(seeds, 5.0), exceptions, 0.5)
    small_batches(docs.sparkSession)
    sample = sample_rows(docs, labels, settings)
    w0, w1 = class_weights(labels, settings)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    sample = sample.groupBy(digest.alias("digest"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic").persist()
    try:
        sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
        counts = _counted(sample, _entries(settings.stems)).persist()
        least = max(settings.least_texts, settings.least_share * n1)
        a, b = F.col("a") * F.lit(w1), F.col("b") * F.lit(w0)
        precise = a >= F.lit(settings.least_precision) * (a + b)
        learned = counts.where(~F.col("unit").isin(*seeds)) \
            .where((F.col("a") >= least) & (odds >= settings.least_odds) & precise) \
            .orderBy(odds.desc(), "unit").limit(settings.lexicon).collect()
        of_seeds = {r.unit: (r.a, r.b) for r in counts.where(F.col("unit").isin(*seeds)).collect()}
        counts.unpersist()

        def weight(a: float, b: float) -> float:
            return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

        weights = {r.unit: weight(r.a, r.b) for r in learned}
        for w in seeds:
            toxic, clean = of_seeds.get(w, (0, 0))
            value = weight(toxic + settings.prior, clean) if n1 else 5.0
            if value > 0:
                weights[w] = min(value, 8.0)
        vocabulary = frozenset(weights)

        def pairs(text: str) -> set[str]:
            ws = _WORD.findall(text)
            return {f"{x} {y}" for x, y in zip(ws, ws[1:]) if x in vocabulary or y in vocabulary}

        harmless = _counted(sample, pairs).where((F.col("b") >= 3) & (a * 4 <= b)).orderBy(F.desc("b"), "unit") \
            .limit(settings.lexicon).collect()
        lexicon = Lexicon(weights, exceptions + [r.unit for r in harmless])
        lexicon.cut = _best_cut(sample, lexicon, (w0, w1))
        return lexicon
    finally:
        sample.unpersist()


def _best_cut(sample: DataFrame, lexicon: Lexicon, weights: tuple[float, float] = (1.0, 1.0), step: float = 0.01, top: float = 100.0) -> float:
    """The x that errs least on the rows that the sample stands for (``weights`` of a clean and a toxic row),
    from a histogram of at most ``top / step`` bins; in the middle of the best stretch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for batch in batches:
            xs = [int(min(m.x(t), top) / step) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), batch.column(1)], ["bin", "toxic"])
    rows = sample.mapInArrow(run, "bin long, toxic int").groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect()
    bins: dict[int, list[int]] = {}
    for r in rows:
        bins.setdefault(r.bin, [0, 0])[r.toxic] += r.n
    if not any(v[1] for v in bins.values()):
        return 0.5
    clean_above, toxic_below = sum(v[0] for v in bins.values()), 0
    best, low, high, keys = None, 0, 0, sorted(bins)
    for k, after in zip(keys, [*keys[1:], keys[-1] + 1]):  # cut above bin k
        clean_above, toxic_below = clean_above - bins[k][0], toxic_below + bins[k][1]
        errors = weights[0] * clean_above + weights[1] * toxic_below
        if best is None or errors < best:
            best, low, high = errors, k + 1, after
    return max(step, (low + high) / 2 * step)


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])
    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text") \
        .mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their own columns, that score below ``least``."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for batch in batches:
            yield batch.filter(pa.array([m.score(t) < least for t in batch.column(at).to_pylist()], pa.bool_()))
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, lexicon).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                                        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
