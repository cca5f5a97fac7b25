"""Near-duplicate components with HyperMinHash sketches.

1. Sets: distinct word shingles (64-bit hashes) of the lower-cased text. Texts with the same word
   sequence share one node.
2. Sketch: each shingle falls into one of ``bands * rows`` buckets; a bucket keeps its smallest value
   as a register of leading-zero count and ten mantissa bits. Empty buckets borrow from another one,
   tried in an order fixed by the bucket.
3. Bands of registers are the candidate keys. Shingles that only one candidate has count against it:
   a pair's Jaccard is at most m / (|A| + |B| - m), with m the smaller number of shared shingles, and
   candidates and pairs that this bound rules out go.
4. In two rounds, pairs whose Jaccard estimate, corrected for chance collisions of registers, is
   near the limit (in the second, all pairs with a small set) are verified on the full sets:
   first each node with the best of its bands' smallest nodes; then, within bands, all pairs of
   nodes that the first round left in different components. Large bands are cut into blocks whose
   pairs are separate cells. Within a cell pairs are filtered by sketch; sets go to the cells of
   the members that this leaves, which are compared again there and verified on the full sets, most alike first, skipping nodes that its links already join; so a cell gives fewer links
   than it has nodes. Only pairs with a set above ``CELL_SET`` shingles leave unverified.
5. Components of the verified links.

A pair at the limit of 0.8 is missed by all 38 bands of 5 with probability 3e-7. The sketch filter (5.5
standard errors of a binomial) could miss more pairs of small sets, whose shingles collide in buckets and
are then copied to others: measured at 0.8 with 3.5 standard errors, 50 of 20,000 (4 of 5 shingles shared), 27 of 20,000 (8 of 10),
8 of 12,000 (40 of 50), 3 of 12,000 (80 of 100), 5 of 12,000 (160 of 200), 0 of 12,000 (320 of 400) and 0
of 6,000 (800 of 1000). So pairs with a set of at most ``SMALL_SET`` shingles are verified whatever the
estimate; for others the binomial gives less than the bands' 3e-7. The first round only chooses: what it leaves, the second
sees again. Nothing else is lost: no caps on bands, partners or links.

Defined results: null or empty texts have an empty set and link with nothing, each its own component;
texts with fewer words than a shingle have their whole sequence as one; of rows with a repeated id
the first is the one kept; null ids are largest; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.components import components
from veracity.llm.scratch import Staged, join_counted, parallelism, small_batches, with_unique_ids, without
from veracity.llm.words import Words, grams, mix64, prefix_hash, slices

VALUE_BITS = 44
MANTISSA_BITS = 10
BLOCK = 512             # members of a band that are compared in one task
CELL_SET = 2_000        # shingles up to which sets travel with the members of a band
SMALL_SET = 400         # shingles up to which the estimate rejects no pair; at most CELL_SET
PAIRS_AT_ONCE = 1 << 14
BROADCAST_ROWS = 1_000_000  # node ids; beyond that they are shuffled


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80      # least Jaccard similarity
    bands: int = 38
    rows: int = 5

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - 5.5 * (j * (1 - j) / self.registers) ** 0.5


def shingle_sets(words: Words, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted shingle hashes and a 128-bit digest of the word sequence, of each document."""
    hashes = words.hashes(lower=True)
    runs = grams(hashes, k)
    other = mix64(hashes ^ np.uint64(0xA0761D6478BD642F))
    sets, digests = [], np.empty((len(words.counts), 2), np.uint64)
    for i, n in enumerate(words.counts.tolist()):
        a = words.first[i]
        digests[i] = prefix_hash(hashes[a:a + n]), prefix_hash(other[a:a + n])
        if n >= k:
            sets.append(np.unique(runs[a:a + n - k + 1]))
        else:
            sets.append(digests[i, :1].copy() if n else np.empty(0, np.uint64))
    return sets, digests


class Sketcher:
    def __init__(self, settings: Settings) -> None:
        self.s = settings
        rng = np.random.default_rng(7)
        k = settings.registers
        self.order = np.argsort(rng.random((k, k)), axis=1)
        self.weights = rng.integers(1, 2**63, settings.rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers (uint16) of each set; those of empty sets are all ones."""
        k = self.s.registers
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
        least = np.full(len(sets) * k, np.iinfo(np.uint64).max, np.uint64)
        step = (1 << (63 - VALUE_BITS)) // k
        for lo in range(0, len(sets), step):  # the sort key holds document, bucket and value
            part = slice(sizes[:lo].sum(), sizes[:lo + step].sum())
            bucket = ((flat[part] >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            value = mix64(flat[part] ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - VALUE_BITS)
            key = np.sort((((of[part] - np.uint64(lo)) * np.uint64(k) + bucket) << np.uint64(VALUE_BITS)) | value)
            at = key >> np.uint64(VALUE_BITS)
            first = np.flatnonzero(np.diff(at, prepend=np.uint64(1 << 63)))
            least[at[first].astype(np.int64) + lo * k] = key[first] & np.uint64((1 << VALUE_BITS) - 1)
        least = least.reshape(len(sets), k)
        empty = least == np.iinfo(np.uint64).max
        filled = least.copy()
        doc, reg = np.nonzero(empty & (sizes > 0)[:, None])
        for turn in range(k):  # sets with one shingle need many turns, most sets a few
            if not len(doc):
                break
            source = self.order[reg, turn]
            done = ~empty[doc, source]
            filled[doc[done], reg[done]] = least[doc[done], source[done]]
            doc, reg = doc[~done], reg[~done]
        # value + 1 = fraction * 2**exponent, fraction in [0.5, 1)
        fraction, exponent = np.frexp(np.minimum(filled, np.uint64((1 << VALUE_BITS) - 1)).astype(np.float64) + 1)
        zeros = np.clip(VALUE_BITS - exponent, 0, 63).astype(np.uint16)
        mantissa = ((fraction - 0.5) * (2 << MANTISSA_BITS)).astype(np.uint16)
        return (zeros << np.uint16(MANTISSA_BITS)) | np.minimum(mantissa, np.uint16((1 << MANTISSA_BITS) - 1))

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        s = self.s
        r = registers.reshape(-1, s.bands, s.rows).astype(np.uint64)
        mixed = (mix64(r + np.uint64(1)) * self.weights).sum(axis=2, dtype=np.uint64)
        return mix64(mixed + (np.arange(s.bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def chance(a: np.ndarray, b: np.ndarray, registers: int) -> np.ndarray:
    """Probability that registers of unrelated sets of these sizes agree: the same leading-zero
    count, then the same mantissa."""
    x = np.maximum(a / registers, 1.0)[:, None]
    y = np.maximum(b / registers, 1.0)[:, None]
    edge = 2.0 ** -np.arange(0, 33)

    def of(n: np.ndarray) -> np.ndarray:
        above = (1 - edge) ** n
        return np.diff(above, axis=1)
    return (of(x) * of(y)).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of register rows."""
    c = chance(na, nb, ra.shape[1])
    return ((ra == rb).mean(axis=1) - c) / (1 - c)


def _registers(column: pa.Array, k: int) -> np.ndarray:
    """A column of binary register rows as a matrix."""
    if not len(column):
        return np.empty((0, k), np.uint16)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint16).reshape(-1, k)


def sketched(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, text_hash, digest, n (set size) and band keys (empty for an empty set)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(settings)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                sets, digests = shingle_sets(Words(data, offsets), settings.shingle)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = sk.keys(sk.registers(sets))[n > 0].astype(np.int64)
                ends = np.concatenate([[0], np.cumsum((n > 0) * settings.bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1, 3)),
                     pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    ["doc_id", "row", "text_hash", "digest", "n", "keys"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")) \
        .mapInArrow(run, "doc_id long, row long, text_hash long, digest binary, n long, keys array<long>")


def node_sets(docs: DataFrame, nodes: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """(node, set, registers) of the given nodes (columns doc_id, text_hash, digest, node), read again from the
    texts. Rows with equal id and text give a node several times."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(settings)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                sets, digests = shingle_sets(Words(data, offsets), settings.shingle)
                wanted = batch.column(1).slice(lo, hi - lo).to_pylist()
                same = [i for i, d in enumerate(digests) if d.tobytes() == wanted[i]]
                sets = [sets[i] for i in same]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(same, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64))),
                     pa.array([r.tobytes() for r in sk.registers(sets)], pa.binary())], ["node", "set", "registers"])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    return texts.join(nodes, F.col("id").eqNullSafe(nodes["doc_id"]) & (F.col("hash") == nodes["text_hash"])) \
        .select("node", "digest", "text").mapInArrow(run, "node long, set array<long>, registers binary")


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            (fx, ox), (fy, oy) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (x, y))
            keep = []
            for i in range(batch.num_rows):
                p, q = fx[ox[i]:ox[i + 1]], fy[oy[i]:oy[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= settings.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    ends = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")  # else all sets are shuffled
    return pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a") \
        .join(ends.select(F.col("node").alias("b"), F.col("set").alias("y")), "b") \
        .select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def with_shared(sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """``sketches`` with ``shared``: how many of a node's shingles some other candidate has too."""
    alone = sets.select("node", F.explode("set").alias("s")).groupBy("s") \
        .agg(F.min("node").alias("node"), F.count("*").alias("k")).where("k = 1") \
        .groupBy("node").agg(F.count("*").alias("alone"))
    return sketches.join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")


def best_stars(members: DataFrame, sketches: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): each node with the most similar of its bands' smallest nodes, where near the limit."""
    k = settings.registers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            e = estimate(_registers(batch.column(4), k), _registers(batch.column(5), k), na, nb) if len(na) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(e, pa.float64())], ["a", "b", "e"])
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    side = [sketches.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("registers").alias("r" + c),
                            F.col("shared").alias("s" + c)) for c in "ab"]
    most = F.least("sa", "sb")
    possible = 100 * most >= settings.percent * (F.col("na") + F.col("nb") - most)
    scored = stars.join(side[0], "a").join(side[1], "b").where(possible).select("a", "b", "na", "nb", "ra", "rb") \
        .mapInArrow(run, "a long, b long, e double").where(F.col("e") >= settings.least_estimate)
    return scored.groupBy("b").agg(F.max(F.struct("e", (-F.col("a")).alias("a"))).alias("best")) \
        .select((-F.col("best.a")).alias("a"), "b")


def _cells(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where each run of equal (key, i, j) starts, and the end."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.append(np.flatnonzero(new), len(key))


def crossing_pairs(members: DataFrame, labels: DataFrame, sketches: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, sure): pairs within a band, in different components, of a small set or with an estimate near the limit.
    ``sure`` ones are verified links, enough to join all that the cell's links join.

    A band of more than ``BLOCK`` nodes is dealt into blocks; each pair of blocks is a cell of its own.
    Cells, not bands, are the unit of work, and a pair leaves only from the first band it shares."""
    s, k = settings, settings.registers

    def near(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers and estimates of the pairs that the sketches leave, each in the first band it shares."""
        key, i, j, block, comp, n, shared = (
            rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "component", "n", "shared"))
        regs = _registers(rows.column("registers").combine_chunks(), k)
        borders = _cells(key, i, j)
        sk = Sketcher(s)
        xs, ys, waiting = [], [], 0

        def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, y = np.concatenate(xs), np.concatenate(ys)
            same = regs[x] == regs[y]
            e = estimate(regs[x], regs[y], n[x], n[y])
            band = same.reshape(len(x), s.bands, s.rows).all(axis=2)
            first = sk.keys(regs[x])[np.arange(len(x)), band.argmax(axis=1)].astype(np.int64)
            close = (e >= s.least_estimate) | (np.minimum(n[x], n[y]) <= SMALL_SET)
            ok = close & (first == key[x])
            return x[ok], y[ok], e[ok]

        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if i[lo] == j[lo]:
                p, q = np.triu_indices(hi - lo, 1)
            else:
                left = np.flatnonzero(block[lo:hi] == i[lo])
                right = np.flatnonzero(block[lo:hi] == j[lo])
                p, q = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
            p, q = p + lo, q + lo
            most = np.minimum(shared[p], shared[q])
            open_ = (comp[p] != comp[q]) & (100 * most >= s.percent * (n[p] + n[q] - most))
            p, q = p[open_], q[open_]
            for at in range(0, len(p), PAIRS_AT_ONCE):
                xs.append(p[at:at + PAIRS_AT_ONCE])
                ys.append(q[at:at + PAIRS_AT_ONCE])
                waiting += len(xs[-1])
                if waiting >= PAIRS_AT_ONCE:
                    yield flush()
                    xs, ys, waiting = [], [], 0
        if waiting:
            yield flush()

    def paired(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The members of a cell that are in any of its pairs."""
        found = np.zeros(rows.num_rows, bool)
        for x, y, _ in near(rows):
            found[x] = found[y] = True
        yield from rows.select(["key", "i", "j", "block", "node", "component"]).filter(pa.array(found)).combine_chunks().to_batches()

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        lists = rows.column("set").combine_chunks()
        ends, flat, known = lists.offsets.to_numpy(), lists.values.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        def linked(i: int, j: int) -> bool:
            p, q = flat[ends[i]:ends[i + 1]], flat[ends[j]:ends[j + 1]]
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= s.percent * (len(p) + len(q) - both)

        for x, y, e in near(rows):
            found, sure = [], []
            for o in np.argsort(-e, kind="stable").tolist():
                i, j = x[o], y[o]
                ci, cj = root(int(comp[i])), root(int(comp[j]))
                if ci == cj:
                    continue
                verify = bool(known[i] and known[j])
                if verify and not linked(i, j):
                    continue
                if verify:
                    parent[max(ci, cj)] = min(ci, cj)
                found.append(o)
                sure.append(verify)
            a, b = node[x[found]], node[y[found]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure, pa.bool_())],
                                             ["a", "b", "sure"])

    def whole_cells(of: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []  # rows of the last, maybe unfinished cell
            for batch in batches:
                rows = pa.Table.from_batches([*held, batch])
                if not rows.num_rows:
                    continue
                last = int(_cells(*(rows.column(c).to_numpy() for c in ("key", "i", "j")))[-2])
                if last:
                    yield from of(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
            if held:
                yield from of(pa.Table.from_batches(held))
        return run

    labelled = members.select("key", "node").join(labels, "node", "left") \
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x <> y").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    parts = parallelism(members.sparkSession)

    def in_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    sketched_rows = sketches.select("node", "n", "shared", "registers")
    # sets are many times larger than registers, and nodes share many bands: a set goes only to the cells that verify it
    pairing = in_cells(dealt.join(sketched_rows, "node")) \
        .mapInArrow(whole_cells(paired), "key long, i int, j int, block int, node long, component long")
    return in_cells(pairing.join(sketched_rows, "node").join(sets.where(F.size("set") <= CELL_SET), "node", "left")) \
        .mapInArrow(whole_cells(compare), "a long, b long, sure boolean")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the component), kept (one row a component),
    row (a number for each row)."""
    small_batches(docs.sparkSession)
    used: list[Staged] = []

    def stage(df: DataFrame, what: str) -> DataFrame:
        used.append(Staged(df, what))
        return used[-1].df

    rows = stage(sketched(docs, settings, id_col, text_col), "sketches")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("row"))
    nodes = stage(rows.where("n > 0").groupBy("digest").agg(F.min(order).alias("first"))
                  .select("digest", F.col("first.row").alias("node")), "nodes")
    sketches = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi") \
        .withColumnRenamed("row", "node")
    banded = sketches.select("node", F.explode("keys").alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    members = stage(join_counted(banded, shared, ["key"]).select("key", "node"), "bands")
    sketches = sketches.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash", "digest", "n")
    sets = node_sets(docs, sketches.select("doc_id", "text_hash", "digest", "node"), settings, id_col, text_col)
    if rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])
    sets = Staged(sets, "sets")
    sketches = sketches.select("node", "n").join(sets.df.select("node", "registers"), "node")
    full = sets.df.select("node", "set")
    sketches = stage(with_shared(sketches, full).where(100 * F.col("shared") >= settings.percent * F.col("n")), "candidates")
    able = sketches.select("node")
    members = stage(members.select("key", "node").join(able, "node", "left_semi"), "bands")
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = members.join(pivots.select("key", "pivot"), "key")

    stars = stage(best_stars(members, sketches, settings), "stars")
    links = stage(verified(stars, full, settings), "links")
    first = components(links)

    pairs = stage(crossing_pairs(members, first, sketches, full, settings), "pairs")
    links = stage(links.union(pairs.where("sure").select("a", "b"))
                  .union(verified(pairs.where("not sure").select("a", "b").distinct(), full, settings)), "links")
    sets.drop()
    labels = components(links)

    # from nodes back to rows; copies of one text follow their node
    of_digest = nodes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    placed = rows.select("doc_id", "row", "n", "digest").join(
        of_digest, (rows["digest"] == of_digest["digest"]) & (rows["n"] > 0), "left") \
        .select("doc_id", "row", "n", F.coalesce("component", "row").alias("component"))
    placed = Staged(placed, "placed").df
    heads = placed.groupBy("component").agg(F.min(order).alias("head")) \
        .select("component", F.col("head.row").alias("head_row"), F.col("head.id").alias("head_id"))
    for table in used:
        table.drop()
    return placed.join(heads, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), F.nullif("head_id", F.lit((1 << 63) - 1)).alias("component_id"),
        (F.col("row") == F.col("head_row")).alias("kept"), "row")


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with their own columns, that stay: one of each component."""
    docs, id_col = with_unique_ids(docs)
    return without(docs, id_col, near_duplicates(docs, settings, id_col).where("not kept").select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, Settings(shingle=4)).select("doc_id", "n_shingles", "component_id", "kept")
