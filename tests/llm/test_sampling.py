"""Importance resampling, mixing and spelling variants against brute force."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import crc, importance, mixing, variants
from veracity.llm.running import running_total
from veracity.llm.scratch import Staged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_crc_of_spans_equals_zlib():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    spans = [(0, 1), (5, 5), (0, 60_000), (17, 59_999), (100, 164), (100, 165), (100, 163), (3, 131)]
    spans += [(a, min(60_000, a + rng.choice([0, 1, 2, 3, 4, 5, 9, 63, 64, 65, 127, 128, 129, 700, 5000]))) for a in rng.choices(range(59_000), k=400)]
    starts, ends = (np.array(x) for x in zip(*spans))
    array = np.frombuffer(data, np.uint8)
    expected = [zlib.crc32(data[a:b]) for a, b in spans]
    assert crc.crc32(array, starts, ends).tolist() == expected
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(len(spans))], np.uint32) ^ crc.FULL
    after = crc.advance(begun, ends - starts) ^ crc.registers(array, starts, ends) ^ crc.FULL
    assert after.tolist() == [zlib.crc32(data[a:b], zlib.crc32(b"%d:" % i)) for i, (a, b) in enumerate(spans)]
    assert crc.crc32(array, starts[:0], ends[:0]).tolist() == []


def test_running_total_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(50), rng.randrange(9), i) for i in range(3000)]
    df = Staged(spark.createDataFrame(rows, "g long, o long, v long, i long").repartition(5), "test").df
    got = sorted(tuple(r) for r in running_total(df, "g", [F.desc("o"), F.col("i")], "v", "before").collect())
    expected = []
    for g in {r[0] for r in rows}:
        done = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[3])):
            expected.append((*r, done))
            done += r[2]
    assert got == sorted(expected)


def _features(text, least, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(least, most + 1) for i in range(len(words) - k + 1)]


def _resampled(rows, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    source = Counter(bucket(f) for _, t in rows for f in _features(t, s.least, s.most)[1])
    goal = Counter(bucket(f) for t in target for f in _features(t, s.least, s.most)[1])
    S, T, out = sum(source.values()), sum(goal.values()), []
    for i, t in rows:
        words, found = _features(t, s.least, s.most)
        w = sum(math.floor(1000 * math.log((goal[b] + 1) * (S + s.buckets) / ((source[b] + 1) * (T + s.buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in out if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for n, r in enumerate(ranked[:s.percent * len(ranked) // 100]):
        r[5] = n + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("settings", [importance.Settings(), importance.Settings(1, 3, buckets=97, least_words=5, percent=50), importance.Settings(2, 2, percent=100)])
def test_resampling_against_brute_force(spark, odd_docs, odd_texts, settings):
    target = [odd_texts[5][1], "Éa b2-b2 ß\x7f  word", None, "", "x " * 500]
    got = importance.resample(odd_docs, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), settings).collect()
    assert sorted(str([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]]) for r in got) == _resampled(odd_texts, target, settings)


def test_drawn_documents_keep_their_columns(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("some words",)], "text string")
    s = importance.Settings(percent=50)
    ranked = importance.resample(odd_docs, target, s)
    drawn = importance.draw(odd_docs, target, s)
    assert drawn.columns == odd_docs.columns
    assert drawn.count() == ranked.where("rank is not null").count() == ranked.where("n_words >= 20").count() // 2
    assert importance.resample(no_docs, target).collect() == []
    none = importance.resample(odd_docs, target.limit(0))
    assert none.count() == odd_docs.count() and none.where("rank is not null").count() > 0


def test_targets_share_the_excess_again():
    assert mixing.targets([100, 10, 100], [3.0, 1.0, 2.0], 300.0, 2) == [168.0, 20.0, 112.0]
    assert mixing.targets([0, 0], [3.0, 1.0], 0.0, 2) == [0.0, 0.0]
    sizes = [7, 900, 31, 0, 250]
    goal = mixing.targets(sizes, [3.0, 1.0, 2.0, 3.0, 1.0], 1.5 * sum(sizes), 2)
    assert math.isclose(sum(goal), 1.5 * sum(sizes)) and all(g <= 2 * s for g, s in zip(goal, sizes))
    free = [g / w for g, w, s in zip(goal, [3, 1, 2, 3, 1], sizes) if g < 2 * s]
    assert max(free) - min(free) < 1e-9


def _cheapest(patterns, quotas, most):
    """By trying every routing of small numbers: the largest flow, and its least cost."""
    best = (-1, 0)
    choices = [list(itertools.product(range(most * words + 1), repeat=len(members))) for members, words in patterns]
    for flows in itertools.product(*choices):
        if any(sum(f) > most * words for f, (_, words) in zip(flows, patterns)):
            continue
        got = Counter()
        for f, (members, _) in zip(flows, patterns):
            for s, x in zip(members, f):
                got[s] += x
        if any(got[s] > q for s, q in enumerate(quotas)):
            continue
        best = max(best, (sum(got.values()), -sum(_cost(sum(f), words) for f, (_, words) in zip(flows, patterns))))
    return best


def _cost(flow, words):
    return sum(max(0, min(flow, (k + 1) * words) - k * words) * k for k in range(8))


def test_flow_is_largest_and_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 3)
        patterns = [(sorted(rng.sample(range(n), rng.randint(1, min(2, n)))), rng.randint(0, 2)) for _ in range(rng.randint(1, 3))]
        quotas = [rng.randint(0, 5) for _ in range(n)]
        flows = mixing.route(patterns, quotas, 2, 1)
        got = Counter()
        for row, (members, words) in zip(flows, patterns):
            assert 0 <= sum(row) <= 2 * words
            for s, x in zip(members, row):
                got[s] += x
        assert all(got[s] <= q for s, q in enumerate(quotas))
        cost = -sum(_cost(sum(row), words) for row, (_, words) in zip(flows, patterns))
        assert (sum(got.values()), cost) == _cheapest(patterns, quotas, 2), (patterns, quotas, flows)


def test_mix_of_overlapping_sources(spark, odd_docs, odd_texts):
    names = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("a"), F.lit(None))) \
        .when(F.col("doc_id") == 11, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 2, F.array(F.lit("É\"x")))
    mixed, plan = mixing.mix(odd_docs, names)
    rows = mixed.collect()
    assert [s.name for s in plan.sources] == ["a", "b", "É\"x", None] and [s.weight for s in plan.sources] == [3, 1, 2, 3]
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in odd_texts)
    assert all(0 <= r.taken == sum(s.taken for s in r.shares) <= 2 * r.size for r in rows)
    got = Counter()
    for r in rows:
        for s in r.shares:
            got[s.source] += s.taken
    assert [got[s.name] for s in plan.sources] == [s.routed for s in plan.sources]
    assert all(s.routed <= math.floor(s.target + 0.5) for s in plan.sources) and sum(got.values()) > 0
    # one document at a border is cut; all others are taken in whole copies
    assert sum(bool(r.size and r.taken % r.size) for r in rows) <= 5
    again, _ = mixing.mix(odd_docs.repartition(7), names)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(again.collect()) == key(rows)


def test_mix_meets_targets_of_single_sources(spark, no_docs):
    docs = spark.createDataFrame([(i, "w " * (i % 40), None if i % 7 == 0 else f"s{i % 5}") for i in range(500)] + [(500, "w " * 4000, "s1")],
                                 "doc_id long, text string, source string")
    mixed, plan = mixing.mix(docs, F.array("source"))
    taken = {r.pattern: r.t for r in mixed.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    assert len(taken) == 6 == len(plan.sources)
    assert all(s.routed == math.floor(s.target + 0.5) for s in plan.sources)
    assert sorted(taken.values()) == sorted(s.routed for s in plan.sources)
    empty, plan = mixing.mix(no_docs, F.array("source"))
    assert empty.collect() == [] and plan.sources == []


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows, s):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if s.every and h % s.every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    words = sorted(w for w in n if len(w) >= s.least_length and n[w] >= s.least_n)
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= s.ratio * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def misspelled():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randint(6, 8))) for _ in range(25)] + ["Z" * 90, "x" * 300]
    def edited(w):
        at = rng.randrange(len(w))
        return rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcdÉ") + w[at:], w[:at] + rng.choice("abcdÿ") + w[at + 1:]])
    pool = [w for base in words for w in [base] * 30 + [edited(base) for _ in range(12)] * 6 + [edited(edited(base)) for _ in range(3)]]
    texts = [rng.choice([" ", "-", "1", "× ", "\nĀ"]).join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(220)]
    return list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (4, None), (5, ""), (6, " ".join(rng.choices(pool, k=4000)))]


@pytest.mark.parametrize("every, tile", [(199, 2048), (3, 4), (0, 1)])
def test_variants_against_brute_force(spark, misspelled, every, tile, monkeypatch):
    monkeypatch.setattr(variants, "TILE", tile)
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in misspelled], "doc_id long, text string, word string, n int").repartition(4)
    s = variants.Settings(every=every)
    got = sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in variants.variants(df, s).collect())
    assert got == _variants(misspelled, s) and len(got) > 50


def test_no_variants(spark, no_docs):
    assert variants.variants(no_docs).collect() == []


def test_distances_find_exactly_the_near_words():
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abcxä"), rng.integers(5, 8))) for _ in range(900)})
    by_length = {k: variants.Block(w := [x for x in words if len(x) == k], np.ones(len(w), np.int64)) for k in (5, 6, 7)}
    for k, block in by_length.items():
        i, j = variants.near_pairs(block, block, 0, upper=True)
        assert {(block.words[a], block.words[b]) for a, b in zip(i, j)} == {(a, b) for a, b in itertools.combinations(block.words, 2) if _near(a, b)}
        if k < 7:
            longer = by_length[k + 1]
            i, j = variants.near_pairs(block, longer, 1)
            assert {(block.words[a], longer.words[b]) for a, b in zip(i, j)} == {(a, b) for a in block.words for b in longer.words if _near(a, b)}
