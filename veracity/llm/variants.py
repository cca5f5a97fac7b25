"""Spelling variants of frequent words, by blocked Gram matrices of letter counts.

1. Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. They are counted in the task, then together. A hash of
   document and word may delete one letter of an occurrence (``misspell``); its CRC-32 is taken for all words of a slice at once.
2. Words of at least ``least_length`` letters and ``least_n`` occurrences form blocks of equal length and equal numbers of
   letters of ``CLASSES`` kinds. One edit leads into the same block, into a block with one letter of one kind for another,
   or into one of the next length; so each block meets itself and ten others, and no other pair of words.
3. A block meets the others in one group: NumPy products of letter-count matrices give squared distances. Distance 2 at
   equal length and 1 at the next may be one edit; these pairs are verified letter by letter.
   Blocks of more than ``TILE`` words are cut into tiles, and what they meet streams past a tile, so memory is bounded.
4. A word's form is its most frequent near word if that is ``ratio`` times as frequent. Roots follow forms by doubling.

Every word meets eleven groups whatever the vocabulary; work in a group grows with the square of a block. No pair but the near ones leaves
a group.

Defined results: null and empty texts have no words. A null id counts as an empty one in the hash. A text or word of any
length is taken whole. Ties of form go to the smallest in code-point order; forms grow in frequency, so roots end.
Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm import crc
from veracity.llm.importance import CRC, CRC_TABLE
from veracity.llm.scratch import Staged, parallelism, ship_package, small_batches
from veracity.llm.words import slices


@dataclass(frozen=True)
class Settings:
    """``every``: one occurrence in so many loses a letter (0: none)."""
    least_length: int = 6
    least_n: int = 5
    ratio: int = 5
    every: int = 199


CLASSES = 4
TILE = 2048
HELD_WORDS = 200_000
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3                                  # of U+00C0 to U+00FF in UTF-8; the byte after it is theirs too
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = _CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def shorter(word: str, h: int) -> str:
    """``word`` without the letter that ``h`` points to."""
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(ids: list, data: np.ndarray, offsets: np.ndarray, every: int, into: Counter) -> None:
    """Counts the words of concatenated texts, of the documents ``ids``, in UTF-8."""
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    clean = np.where(inside, _CLEAN[data], np.uint8(0x20))
    text = clean.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        into.update(text[a:b].split())
    starts, ends, first = crc.runs(inside, offsets)
    if not every or not len(starts):
        return
    named = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32) ^ crc.FULL
    h = crc.advance(np.repeat(named, np.diff(first)), ends - starts) ^ crc.registers(clean, starts, ends) ^ crc.FULL
    for i in np.flatnonzero(h % np.uint32(every) == 0).tolist():
        word = text[starts[i]:ends[i]]
        into[word] -= 1
        into[shorter(word.decode(), int(h[i])).encode()] += 1


def vocabulary(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if n and len(w) - w.count(_LEAD) >= settings.least_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()),
                                               pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, end, data, offsets in slices(batch.column("text")):
                count_words(ids[at:end], data, offsets, settings.every, held)
                if len(held) >= HELD_WORDS:
                    yield rows()
        yield rows()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least_n)


_COLUMN = np.zeros(256, np.int64)
_COLUMN[LETTERS] = np.arange(len(LETTERS))


class Block:
    """Some words with their counts: letters one after the other, letter-count vectors and their squared norms."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n = words, n
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        at = np.repeat(np.arange(len(words)), self.lengths) * len(LETTERS) + _COLUMN[self.letters]
        self.counts = np.bincount(at, minlength=len(words) * len(LETTERS)).reshape(-1, len(LETTERS)).astype(np.float32)
        self.norms = np.einsum("ij,ij->i", self.counts, self.counts)


def one_edit(a: Block, i: np.ndarray, b: Block, j: np.ndarray, gap: int) -> np.ndarray:
    """Which pairs of words of ``a`` and equally long (``gap`` 0) or by one letter longer words of ``b`` are one edit apart."""
    lengths = a.lengths[i]
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    mine = a.letters[np.repeat(a.starts[i], lengths) + within]
    at = np.repeat(b.starts[j], lengths) + within
    differs = mine != b.letters[at]
    if not gap:
        return np.add.reduceat(differs, first) == 1
    cut = np.minimum.reduceat(np.where(differs, within, np.iinfo(np.int64).max), first)   # first letter that differs
    late = within >= np.repeat(cut, lengths)
    return ~np.logical_or.reduceat(late & (mine != b.letters[at + late]), first)


PAIRS = 1 << 14
WIDE = 1024


def near_pairs(a: Block, b: Block, gap: int, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` one edit apart (``upper``: within ``a``, each pair once)."""
    rows, cols = [], []
    twice = 2 * a.counts
    for low in range(0, len(b.words), WIDE):
        some = slice(low, low + WIDE)
        products = twice @ b.counts[some].T            # 2xy = xx + yy - distance
        products -= a.norms[:, None]
        i, j = np.nonzero(products == (b.norms[some] - (1 if gap else 2))[None, :])
        j += low
        if upper:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            p, q = i[k:k + PAIRS], j[k:k + PAIRS]
            ok = one_edit(a, p, b, q, gap)
            rows.append(p[ok])
            cols.append(q[ok])
    none = np.empty(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(cols or [none])


KEY = [f"c{i}" for i in range(CLASSES)]


def classes() -> list[Column]:
    """How many letters of each kind a word has."""
    kinds = ["".join(chr(c) for c in LETTERS if c % CLASSES == k) for k in range(CLASSES)]
    return [(F.length("word") - F.length(F.translate("word", kind, ""))).alias(k) for k, kind in zip(KEY, kinds)]


def groups(words: DataFrame) -> DataFrame:
    """Each word in the group of its own block (side 0), and in those that its block is met by: of equal length (1)
    or one letter shorter (2)."""
    big = F.broadcast(words.groupBy(*KEY).agg(F.count("*").alias("m")).where(F.col("m") > TILE)       # a row for TILE words at most
                      .select(*KEY, F.ceil(F.col("m") / TILE).cast("int").alias("tiles")))
    tiles = F.coalesce(F.col("tiles"), F.lit(1))
    own = words.join(big, KEY, "left").withColumn("tile", F.pmod(F.xxhash64("word"), tiles).cast("int")).drop("tiles")
    again = own.where("tile > 0").withColumn("tile", F.explode(F.expr("sequence(0, tile - 1)")))
    steps = [([-(k == i) for k in range(CLASSES)], 2) for i in range(CLASSES)]
    steps += [([(k == i) - (k == j) for k in range(CLASSES)], 1) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    met = F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(KEY, step)), F.lit(side).alias("side")) for step, side in steps)))
    others = words.select("word", "n", met.alias("met")).select("word", "n", "met.*") \
        .where(reduce(lambda x, y: x & y, (F.col(c) >= 0 for c in KEY))).join(big, KEY, "left") \
        .withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("tiles")
    columns = [*KEY, "tile", "side", "word", "n"]
    return own.withColumn("side", F.lit(0)).select(columns).unionByName(again.withColumn("side", F.lit(1)).select(columns)) \
        .unionByName(others.select(columns))


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for each two words one edit apart, both ways."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (*KEY, "tile", "side")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            names, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            found: list[tuple[Block, np.ndarray, Block, np.ndarray]] = []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                *cell, side = keys[low].tolist()
                if cell != key:
                    key, held = cell, []
                if side and not held:
                    continue
                block = Block(names[low:high], n[low:high])
                found += [(a, i, block, j) for a in held for i, j in [near_pairs(a, block, gap=side == 2)]]
                if not side:
                    i, j = near_pairs(block, block, 0, upper=True)
                    found.append((block, i, block, j))
                    held.append(block)
            word, near, counts = [], [], []
            for a, i, b, j in found:
                left, right = [a.words[x] for x in i], [b.words[x] for x in j]
                word += left + right
                near += right + left
                counts += [b.n[j], a.n[i]]
            if word:
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()),
                                                  pa.array(np.concatenate(counts), pa.int64())], names=["word", "near", "near_n"])

    ship_package(words.sparkSession)
    cell = [*KEY, "tile"]
    return groups(words).repartition(parallelism(words.sparkSession), *cell).sortWithinPartitions(*cell, "side", "word") \
        .mapInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last, in rounds that double the steps."""
    stage = Staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = stage.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = Staged(stage.df.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")), "roots")
        stage.drop()
        stage = after
        if not after.df.where("moved").limit(1).count():
            return after.df.select("word", "root")


def variants(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each frequent word."""
    key = [*classes()]
    words = Staged(vocabulary(docs, settings, id_col, text_col).select("word", "n", *key), "vocabulary").df
    near = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.select("word", "n").join(near, "word", "left")
    held = -F.col("best.less") >= settings.ratio * F.col("n")
    known = Staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("best.near")).alias("form"),
                                F.when(held, -F.col("best.less")).alias("form_n")), "forms").df
    return known.join(roots(known.where("form is not null")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with recursive {CRC_TABLE},
runs as (select doc_id, w, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{{00C0}}-\x{{00FF}}]+')) as w from documents) group by all),
hashed as (select w, n, hex(encode(doc_id || ':' || w)) as x from runs),
summed as (select w, n, {CRC} as h from hashed, crc_table),
spelled as (select n, case when h % 199 = 0 then w[1:(h % length(w))::bigint] || w[(h % length(w))::bigint + 2:] else w end as word from summed),
vocabulary as (select word, sum(n)::bigint as n from spelled where length(word) >= 6 group by word having sum(n) >= 5),
masks as (select word, n, i, word[1:i - 1] || '*' || word[i + 1:] as mask, word[1:i - 1] || word[i + 1:] as less
          from vocabulary, range(1, length(word) + 1) r(i)),
near as (select a.word, b.word as near, b.n as near_n from masks a join masks b on a.mask = b.mask and a.word <> b.word
         union select m.word, v.word, v.n from masks m join vocabulary v on v.word = m.less
         union select v.word, m.word, m.n from masks m join vocabulary v on v.word = m.less),
best as (select word, count(*) as n_near, first(near order by near_n desc, near) as form, max(near_n) as form_n from near group by word),
known as (select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * n then form end as form,
                 case when form_n >= 5 * n then form_n end as form_n from vocabulary left join best using (word)),
chain(word, last) as (select word, word from known union all
                    select c.word, k.form from chain c join known k on k.word = c.last where k.form is not null),
ends as (select c.word, c.last as root from chain c join known k on k.word = c.last where k.form is null)
select word, form, root, n, n_near, form_n from known join ends using (word)
"""
