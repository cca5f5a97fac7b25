"""BPE encoding by speculation and verification, and decoding.

Encoding of a word: greedy longest match proposes tokens, a vectorised check tests every adjacent
pair, and only words with a failing pair are merged exactly. The check rests on two facts. A token
sequence is the BPE encoding of its text exactly if each token is the encoding of its own text and
each adjacent pair is the encoding of the pair's text. And a pair (a, b) fails exactly if some merge
joins a token x on the right edge of a's merge tree with a token y on the left edge of b's, while
both are still unmerged: earlier than x's own next merge, and not later than y's own next merge
(of equal merges the left one goes first).

The vocabulary is a byte-level BPE file of the ``tokenizers`` library; its path is a parameter.
Texts are split by that format's fixed pattern. Strings of added tokens become their ids.

Defined results: null counts as empty, an empty text has no ids; whole texts of any length are
encoded; every row gives one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veracity.llm.scratch import small_batches

# The split pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern over given classes of letters, numbers and white space.
EXACT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SHORT_WORD = 32  # bytes up to which pairs are scanned rather than kept in a heap
NEVER = 1 << 62
CACHED_WORDS = 500_000  # in each of two generations
CACHED_LENGTH = 64
SLICE_CHARS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Tables of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE file is needed")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or match whole words only aren't supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        of, vocab = byte_alphabet(), model["vocab"]
        n = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        special = set(self.added.values())
        self.ids = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], int] = {}  # rank << 32 | merged id
        twice = np.zeros(n, bool)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = rank << 32 | z
            twice[z] |= self.rank[z] >= 0
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._ranks = np.append(np.array([v >> 32 for v in self.merges.values()], np.int64)[order], -1)
        # tokens that are the encoding of their own text
        made = np.flatnonzero(self.rank >= 0)
        self.sound = ~twice
        self.sound[made] &= self._joined(self.left[made], self.right[made], self.rank[made])
        while True:
            now = self.sound[made] & self.sound[self.left[made]] & self.sound[self.right[made]]
            if (now == self.sound[made]).all():
                break
            self.sound[made] = now

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def _joined(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int) -> np.ndarray:
        """Whether no merge before ``until`` crosses the border of each pair: walks back in time
        through the pairs (x, y) of edge tokens that exist together."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_until = np.broadcast_to(np.asarray(until, np.int64), a.shape).copy()
        y_until = x_until.copy()
        while len(at):
            m = self._merge_rank(x, y)
            bad = (m >= 0) & (m < x_until) & (m <= y_until)
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            back_x = rx > ry
            x_until, y_until = np.where(back_x, rx, x_until), np.where(back_x, y_until, ry)
            go = ~bad & ((rx >= 0) | (ry >= 0))
            x, y = np.where(back_x, self.right[x], x)[go], np.where(back_x, y, self.left[y])[go]
            x_until, y_until, at = x_until[go], y_until[go], at[go]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each adjacent pair is the encoding of its own text."""
        codes, back = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_inverse=True)
        x, y = codes >> 32, codes & 0xFFFFFFFF
        return (self._joined(x, y, np.iinfo(np.int64).max) & self.sound[x] & self.sound[y])[back]

    def longest_match(self, word: bytes) -> list[int]:
        """The speculation: the longest vocabulary entry at each place."""
        ids, longest, out, i, n = self.ids, self.longest, [], 0, len(word)
        while i < n:
            end = min(n, i + longest.get(word[i:i + 2], 1))
            while end > i + 1 and word[i:end] not in ids:
                end -= 1
            out.append(ids[word[i:end]])
            i = end
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """The merges in order of rank, leftmost first; a heap keeps long words near-linear."""
        ids, merges = [self.ids[word[i:i + 1]] for i in range(len(word))], self.merges
        n = len(ids)
        if n <= SHORT_WORD:
            pairs = [merges.get(p, NEVER) for p in zip(ids, ids[1:])]
            while pairs and (first := min(pairs)) != NEVER:
                i = pairs.index(first)
                ids[i:i + 2] = [first & 0xFFFFFFFF]
                del pairs[i]
                if i:
                    pairs[i - 1] = merges.get((ids[i - 1], ids[i]), NEVER)
                if i < len(pairs):
                    pairs[i] = merges.get((ids[i], ids[i + 1]), NEVER)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            code, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = code & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in merges:
                    heapq.heappush(heap, (merges[p], k, p))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate, verify all adjacent pairs at once, merge the failing words exactly."""
        found = [[i] if (i := self.ids.get(w)) is not None else self.longest_match(w) for w in words]
        if not found:
            return found
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(found)), sizes)
        failed = np.zeros(len(found), bool)
        failed[of[~self.sound[flat]]] = True
        inner = np.flatnonzero(of[1:] == of[:-1])
        if len(inner):
            failed[of[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        for i in np.flatnonzero(failed):
            found[i] = self.merge_exactly(words[i])
        return found

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _ranges(chars: str) -> str:
    """Characters in ascending order as ranges of a character class."""
    points = np.array([ord(c) for c in chars])
    cut = np.flatnonzero(np.diff(points) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.append(0, cut + 1)], points[np.append(cut, -1)]))


@lru_cache(maxsize=1)
def exact_split() -> tuple[re.Pattern, re.Pattern]:
    """The tokenizers library has a Unicode version of its own. The split pattern with its letters, numbers and white space, and
    a pattern for the code points that this process's modules class otherwise; both found by asking the library, once a process."""
    from tokenizers import Regex, pre_tokenizers
    # planes 4 to 13, 15 and 16 have no letters, numbers or spaces
    every = "".join(chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)))
    classes, odd = {}, set()
    for name, own in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        runs = pre_tokenizers.Split(Regex(f"{own}+"), "removed", invert=True).pre_tokenize_str(every)
        theirs = "".join(run for run, _ in runs)
        classes[name] = _ranges(theirs)
        odd |= set(theirs) ^ set("".join(regex.findall(f"{own}+", every)))
        odd |= set(theirs) ^ set(filter(str.isalpha, every)) if name == "L" else set()
        odd |= set(theirs) ^ set("".join(re.findall(r"\s+", every))) if name == "S" else set()
    return regex.compile(EXACT.format(**classes)), re.compile(f"[{_ranges(''.join(sorted(odd)))}]" if odd else r"(?!)")


class Encoder:
    """Encodes whole texts; remembers pieces between texts, within a bound."""

    # A text whose spaces each stand before a non-space falls into pieces that are split alike alone
    # and in place; other texts are split whole.
    _run = re.compile(r" (?:\s|\Z)")

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.split, self.known, self.older = bpe, regex.compile(PATTERN), {}, {}
        self.exact, self.odd = exact_split()
        self.latin = not self.odd.search("".join(map(chr, range(0x80, 0x100))))

    def _is_odd(self, text: str) -> bool:
        """Whether a text has a code point that this process's modules class unlike the library."""
        if text.isascii():
            return False
        if self.latin:
            try:
                text.encode("latin-1")
                return False
            except UnicodeEncodeError:
                pass
        return self.odd.search(text) is not None

    def _pieces(self, text: str) -> list[str]:
        if self._is_odd(text):
            return self.exact.findall(text)
        if self._run.search(text):
            return self.split.findall(text)
        first, *rest = text.split(" ")
        out = [" " + p for p in rest]
        if first:
            out.insert(0, first)
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        split = self.split.findall
        words, counts = [], []
        for p in pieces:
            if self._is_odd(p):
                found = self.exact.findall(p)
            else:
                found = [p] if p[1:].isalpha() and p[0] == " " else split(p)
            counts.append(len(found))
            words += found
        ids = self.bpe.encode_words([w.encode() for w in words])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts, dtype=np.int64))] * 4
        data = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())).tobytes()
        ends = ends.tolist()
        return {p: data[a:b] for p, a, b in zip(pieces, ends, ends[1:])}

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in texts]
        wanted = set().union(*pieces)
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > CACHED_WORDS:
            self.older, self.known, new = self.known, {}, wanted
        again = new & self.older.keys()
        self.known.update((p, self.older[p]) for p in again)
        found = self._learn(list(new - again))
        long = {p: v for p, v in found.items() if len(p) > CACHED_LENGTH}
        self.known.update((p, v) for p, v in found.items() if len(p) <= CACHED_LENGTH)
        known = self.known if not long else {**{p: self.known[p] for p in wanted - long.keys()}, **long}
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        added = self.bpe.added_split
        if added is None or not any(t in s for s in texts for t in self.bpe.added):
            return [np.frombuffer(b, np.uint32) for b in self._encode(texts)]
        parts = [added.split(s) for s in texts]
        ids = iter(self._encode([p for ps in parts for p in ps[::2]]))
        out = []
        for ps in parts:
            row = [next(ids) if i % 2 == 0 else np.uint32(self.bpe.added[p]).tobytes() for i, p in enumerate(ps)]
            out.append(np.frombuffer(b"".join(row), np.uint32))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(Bpe(path))


def text_slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``SLICE_CHARS`` characters, with the number of the first."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for at, texts in text_slices(batch.column(1).to_pylist()):
                ids = enc.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])
    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text") \
        .mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the text that the
    ids give), without moving the ids between tasks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        shown = list(map(str, range(len(enc.bpe.bytes))))
        for batch in batches:
            sizes, of_ids, of_text = [], [], []
            for _, texts in text_slices(batch.column(1).to_pylist()):
                for row in enc.encode(texts):
                    ids = row.tolist()
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(enc.bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_text, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text") \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
