"""Order-preserving packing of tokenised documents into sequences of bounded length.

Each task reads its documents in table order as one token stream and cuts it into windows of at most
``length`` tokens. Cuts go at document ends (free), at sentence ends (penalty ``sentence``) or, within
a sentence longer than ``stride`` tokens, every ``stride`` tokens (penalty ``inside``). Dynamic
programming picks the cuts that minimise padding plus penalties: with P the position of a cut,

    cost(i) = penalty(i) + length - P(i) + min over j, P(i) - P(j) <= length, of cost(j) + P(j)

and the minimum over the sliding range of j comes from a monotone queue, so the work is linear in the
number of cuts. The horizon rolls: after ``HORIZON`` windows the oldest are settled and the last few
stay open, so memory holds some windows or one document, whichever is larger. What is left at the end
of a task, shorter than a full sequence, is cut into lengths that are powers of two, which need no padding.

No shuffle. Sequence ids come from the partition number, so a task that is run again gives the same rows.

Defined results: a null or empty text is the end token alone; documents longer than a sequence are cut;
repeated rows are packed once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from veracity.llm.scratch import small_batches
from veracity.llm.words import Words, slices

HORIZON = 32
OPEN = 4
SLICE = 1 << 20


@dataclass(frozen=True)
class Costs:
    """Sequence length and penalties, in tokens of padding."""
    length: int = 4096
    sentence: float = 4.0
    inside: float = 16.0
    stride: int = 256
    closest: int = 16  # of sentence ends nearer to each other one is a cut


class Packer:
    """Cuts one stream of documents; ``add`` and ``close`` yield settled pieces
    (document, start, length, crc32, document tokens, sequence, offset)."""

    def __init__(self, costs: Costs, first_sequence: int) -> None:
        self.costs, self.sequence = costs, first_sequence
        self.docs: deque = deque()  # (key, ids, position of its first token)
        self.position = 0
        self._restart(0)

    def _restart(self, at: int) -> None:
        self.cuts, self.from_cut, self.value = [at], [-1], [0.0]  # value: cost + position
        self.queue: deque = deque([0])

    def _extend(self, cuts: Iterable[tuple[int, float]]) -> None:
        """Plans (position, penalty) cuts, in ascending order."""
        length, at, value, from_cut, queue = self.costs.length, self.cuts, self.value, self.from_cut, self.queue
        n = len(at)
        for position, penalty in cuts:
            least = position - length
            while at[queue[0]] < least:
                queue.popleft()
            best = queue[0]
            v = value[best] + length + penalty
            at.append(position)
            from_cut.append(best)
            value.append(v)
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(n)
            n += 1

    def add(self, key, ids: np.ndarray, sentence_ends: np.ndarray) -> Iterator[tuple]:
        """``sentence_ends``: token counts, ascending, after which a sentence ends."""
        start, n, costs = self.position, len(ids), self.costs
        self.docs.append((key, ids, start))
        ends = sentence_ends[(sentence_ends > 0) & (sentence_ends < n)]
        ends = ends[np.diff(ends // costs.closest, prepend=-1) > 0] + start
        borders = np.concatenate([[start], ends, [start + n]])
        gaps = np.diff(borders)
        penalties = [costs.sentence] * len(ends) + [0.0]
        if gaps.max() < costs.stride + costs.stride // 2:
            self._extend(zip(borders[1:].tolist(), penalties))
        else:
            for a, b, penalty in zip(borders[:-1].tolist(), borders[1:].tolist(), penalties):
                self._extend((k, costs.inside) for k in range(a + costs.stride, b - costs.stride // 2, costs.stride))
                self._extend([(b, penalty)])
        self.position = start + n
        if self.position - self.cuts[0] >= HORIZON * costs.length:
            yield from self._settle(OPEN)

    def _windows(self) -> list[int]:
        """Cuts of the best packing of all but the tail: it ends at the cut, less than a sequence
        before the last position, with the least padding and penalties."""
        last, length = self.cuts[-1], self.costs.length
        ends = range(bisect.bisect_right(self.cuts, last - length), len(self.cuts))
        path, i = [], min(ends, key=lambda j: (self.value[j] - self.cuts[j], -j))
        while i >= 0:
            path.append(self.cuts[i])
            i = self.from_cut[i]
        return path[::-1]

    def _settle(self, keep: int) -> Iterator[tuple]:
        cuts, penalties = self.cuts, self.value
        path = self._windows()
        settled = path[:len(path) - keep]
        for a, b in zip(settled, settled[1:]):
            yield from self._emit(a, b)
        # the open part is planned anew from the last settled cut, with the same cuts and penalties
        at = settled[-1]
        i = cuts.index(at)
        later = [(cuts[j], penalties[j] - penalties[self.from_cut[j]] - self.costs.length)
                 for j in range(i + 1, len(cuts))]
        self._restart(at)
        self._extend(later)

    def _emit(self, a: int, b: int) -> Iterator[tuple]:
        sequence, self.sequence = self.sequence, self.sequence + 1
        at = a
        while at < b:
            key, ids, first = self.docs[0]
            end = min(b, first + len(ids))
            part = ids[at - first:end - first]
            yield key, at - first, end - at, zlib.crc32(part), len(ids), sequence, at - a
            if end == first + len(ids):
                self.docs.popleft()
            at = end

    def close(self) -> Iterator[tuple]:
        """Settles the rest; the tail becomes powers of two."""
        path = self._windows()
        for a, b in zip(path, path[1:]):
            yield from self._emit(a, b)
        at = path[-1]
        while at < self.position:
            size = 1 << ((self.position - at).bit_length() - 1)
            yield from self._emit(at, at + size)
            at += size


class IdTable:
    """Ids by word hash: an open-addressing table over one pool of ids, with vectorised probes.
    It starts anew once ``most`` words are in it, so its memory is bounded."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most, self.slots = most, 1 << (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.pool = np.empty(1 << 20, np.uint32)
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.count = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.arange(len(hashes))
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(at):
            entry = self.entry[slot]
            hit = (entry >= 0) & (self.keys[slot] == hashes[at])
            out[at[hit]] = entry[hit]
            go = (entry >= 0) & ~hit
            at, slot = at[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds distinct new hashes, with their ids one after the other; their entries."""
        n = len(hashes)
        while self.count + n > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        entries = np.arange(self.count, self.count + n, dtype=np.int32)
        self.pool[self.used:self.used + len(ids)] = ids
        self.begin[entries] = self.used + np.cumsum(sizes) - sizes
        self.size[entries] = sizes
        self.count, self.used = self.count + n, self.used + len(ids)
        at, slot = np.arange(n), (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(at):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[at[free]]  # of several for one slot the last stays
            lost = ~free | (self.entry[slot] != entries[at])
            won = ~lost
            self.keys[slot[won]] = hashes[at[won]]
            at, slot = at[lost], (slot[lost] + 1) & (self.slots - 1)
        return entries

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries one after the other, and where each ends."""
        size = self.size[entries].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) - np.repeat(ends - size - self.begin[entries], size)], ends


class Tokens:
    """Ids of whole texts by the tokenizers library, word by word: this kind of vocabulary drops
    white space and neither its normaliser nor its split pattern looks across it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = IdTable()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends, self.last = np.zeros(size, bool), np.zeros(size, bool)  # ends a sentence, a part of a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
            self.ends[i] = self.last[i] and token.removesuffix("</w>")[-1:] in (".", "!", "?")

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their counts. Words of letters, with or without one stop or comma behind,
        go in one text: they have one or two parts, and each part ends with a token of kind ``last``."""
        parts = []
        for w in words:
            low = w.lower()
            parts.append(1 if low.isalpha() else 2 if low[-1] in ".," and low[:-1].isalpha() else 0)
        parts = np.array(parts)
        plain = np.flatnonzero(parts)
        rows: list = [None] * len(words)
        if len(plain):
            text = " ".join([words[i] for i in plain.tolist()])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == parts.sum():
                if len(plain) == len(words):
                    return ids, np.diff(ends[np.cumsum(parts) - 1], prepend=0)
                ends = ends[np.cumsum(parts[plain]) - 1].tolist()
                for i, a, b in zip(plain.tolist(), [0, *ends], ends):
                    rows[i] = ids[a:b]
            else:  # a letter here that the tokenizer takes for something else
                parts[:] = 0
        other = np.flatnonzero(parts == 0).tolist()
        for i, r in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)):
            rows[i] = np.array(r.ids, np.uint32)
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``offsets`` of ``data``, one after the other; where each text ends."""
        words, known = Words(data, offsets), self.known
        if not len(words):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        entries = known.find(hashes)
        new = np.flatnonzero(entries < 0)
        if known.count + len(new) > known.most:
            known.clear()
            entries[:] = -1
            new = np.arange(len(hashes))
        if len(new):
            raw = data.tobytes()
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())
            entries[new] = known.add(hashes[new], *self._learn([raw[a:b].decode() for a, b in spans]))
        ids, ends = known.ids(entries[back])
        return ids, np.append(0, ends)[words.first[1:]]


@lru_cache(2)
def tokens(path: str) -> Tokens:
    """One a Python worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, costs: Costs = Costs(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(vocabulary)
        end = np.uint32(end_id)
        packer = Packer(costs, TaskContext.get().partitionId() << 33)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offsets in slices(batch.column(1), SLICE):
                pieces: list[tuple] = []
                ids, ends = tok.encode(data, offsets)
                at = 0
                for key, upto in zip(keys[lo:hi], ends.tolist()):
                    row = np.append(ids[at:upto], end)
                    pieces.extend(packer.add(key, row, np.flatnonzero(tok.ends[row]) + 1))
                    at = upto
                if pieces:
                    yield rows(pieces)
        if pieces := list(packer.close()):
            yield rows(pieces)

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text") \
        .mapInArrow(run, ", ".join(f"{n} long" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
