"""Exact, near and substring dedup, and the sparse suffix array, against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import digest_index, hyperminhash, passages, suffixes
from veracity.llm.components import components
from veracity.llm.scratch import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def covered(texts, length):
    """For each text, which words lie in a window that starts anywhere else too."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[k:k + length]) for w in all_words for k in range(len(w) - length + 1))
    out = []
    for w in all_words:
        flags = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                flags[k:k + length] = [True] * length
        out.append(flags)
    return out


def test_exact_dedup_against_brute_force(odd_docs, odd_texts):
    groups = defaultdict(list)
    for i, t in odd_texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    rows = digest_index.deduplicate(odd_docs).collect()
    assert len(rows) == len(odd_texts)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in rows:
        members = by_digest[r.digest.hex()]
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(members))
        kept[r.digest.hex()] += r.kept
    assert set(kept.values()) == {1}   # of repeated rows, too, exactly one stays


def test_digest_index_persists(spark, odd_docs):
    path = new_path(spark, "index")
    first = digest_index.DigestIndex(spark, path, 4)
    before = {r.digest: r.keep_id for r in first.deduplicate(odd_docs).where("kept").collect()}
    new = spark.createDataFrame([(900, "word"), (901, "never seen"), (902, "never  seen")], "doc_id long, text string")
    again = digest_index.DigestIndex(spark, path, 4)
    got = {r.doc_id: r for r in again.deduplicate(new).collect()}
    assert (got[900].kept, got[900].keep_id) == (False, 4) and got[902].kept and not got[901].kept
    stored = {r.digest: r.keep_id for r in again.read().collect()}
    assert {k: stored[k] for k in before} == before and len(stored) == len(before) + 1


def test_digest_index_keeps_its_bucket_count(spark):
    path = new_path(spark, "index")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert digest_index.deduplicate(docs, path, 4).where("kept").count() == 200
    other = spark.newSession()
    again = digest_index.DigestIndex(other, path, 8)
    assert again.buckets == 4
    assert again.deduplicate(other.createDataFrame(docs.collect(), docs.schema)).where("kept").count() == 0
    assert again.read().count() == 200 and not [t for t in spark.catalog.listTables() if t.name.startswith("veracity_digests")]
    plan = again.absent(docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1        # of the candidates, not of the index


def test_digest_index_gives_a_repeated_batch_the_same_result(spark):
    path = new_path(spark, "index")
    index = digest_index.DigestIndex(spark, path, 4)

    def kept(batch, ids):
        docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
        return sorted(r.doc_id for r in index.deduplicate(docs, batch=batch).where("kept").collect())
    assert kept("a", range(50)) == list(range(50))
    for _ in range(2):
        assert kept("b", range(40, 60)) == list(range(50, 60))
    assert kept("a", range(50)) == list(range(50))                       # run again after another batch
    for n in range(digest_index.MOST_PARTS + 1):
        assert kept(f"c{n}", [100 + n, 0]) == [100 + n]
    assert len(index.parts()) <= digest_index.MOST_PARTS and index.read().count() == 60 + digest_index.MOST_PARTS + 1
    assert kept("a", range(50)) == list(range(50)) and kept("d", range(50)) == []


def test_regular_words_have_hashes_of_their_own(spark):
    from veracity.llm.words import Words
    turns = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join(pair[t] for t in turns) for pair in ("ab", "ba"))      # Thue-Morse and its complement
    far = ["c" * 5 + x + "c" * 65_535 + y + "c" * 9 for x, y in ("ab", "ba")]
    data = " ".join([one, two, *far]).encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(words.hashes().tolist())) == len(set(words.hashes(lower=True).tolist())) == 4
    rest = [f"w{i}" for i in range(40)]
    texts = [" ".join([x, *rest[:34]]) for x in (one, two)] + [" ".join([x] * 6) for x in (one, two, *far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs.where("doc_id > 1"), hyperminhash.Settings(shingle=4)).collect()}
    assert near == {i: i for i in range(2, 6)}
    assert all(r.n_removed == 0 for r in passages.summary(docs).collect())


def test_a_users_own_row_id_stays(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, "b", 9)], "doc_id long, text string, __row_id int")
    kept = digest_index.without_copies(docs)
    assert kept.columns == docs.columns and sorted(r["__row_id"] for r in kept.collect()) == [7, 9]


def test_exact_dedup_runs_no_python(odd_docs):
    plan = digest_index.deduplicate(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_against_brute_force(odd_docs, odd_texts, shingle):
    def shingles(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if len(w) < shingle:
            return frozenset([tuple(w)] if w else [])
        return frozenset(tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1))
    sets = [shingles(t) for _, t in odd_texts]
    parent = list(range(len(sets)))

    def find(x):
        return x if parent[x] == x else find(parent[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i, (key, _) in enumerate(odd_texts):
        group[find(i)].append(key)
    expected = Counter((key, len(sets[i]), min((k for k in group[find(i)] if k is not None), default=None))
                       for i, (key, _) in enumerate(odd_texts))
    rows = hyperminhash.near_duplicates(odd_docs, hyperminhash.Settings(shingle=shingle)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(group)


def test_near_duplicates_within_a_large_band(spark):
    """A group above the block size: chains of copies, each a little further from the first."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(hyperminhash.BLOCK + 150):
        w = list(base)
        w[i % 50 + 4] = f"own{i}"           # one word changed: 5 shingles of 56 differ
        rows.append((i, " ".join(w)))
    far = " ".join(base[:20] + [f"z{i}" for i in range(40)])
    rows.append((10_000, far))
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0, 10_000} and sum(r.kept for r in got) == 2


def test_near_duplicates_of_small_sets(spark):
    """Four of five shingles shared, which the sketch of these pairs estimates far below 0.8."""
    pairs = [53, 308, 454, 627, 773, 1226, 2119, 2761, 2796, 2846, 3728, 3980, 4067, 4276, 4411, 4640, 4828]
    rows = [(2 * i + cut, " ".join(f"a{i}b{k}" for k in range(9 - cut))) for i in pairs for cut in (0, 1)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {2 * i + cut: 2 * i for i in pairs for cut in (0, 1)}


def test_sketch_estimates():
    import numpy as np
    rng = np.random.default_rng(1)
    s = hyperminhash.Settings()
    sk = hyperminhash.Sketcher(s)
    for n, j in ((5, 0.5), (300, 0.8), (20_000, 0.3)):
        both = int(n * j)
        errors = []
        for _ in range(30):
            x = rng.integers(1, 2**63, 2 * n, np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:2 * n - both]]))
            r = sk.registers([a, b])
            e = hyperminhash.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0]
            errors.append(e - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.05


def test_substring_dedup_against_brute_force(odd_docs, odd_texts):
    flags = covered([t for _, t in odd_texts], 35)
    expected = Counter()
    for (key, t), f in zip(odd_texts, flags):
        kept = " ".join(w for w, c in zip(words(t), f) if not c)
        expected[key, len(f), sum(f), hashlib.sha256(kept.encode()).hexdigest()] += 1
    rows = passages.summary(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == expected


def test_without_repeats_keeps_columns(odd_docs, odd_texts):
    flags = covered([t for _, t in odd_texts], 35)
    expected = Counter()
    for (key, t), f in zip(odd_texts, flags):
        text = " ".join(w for w, c in zip(words(t), f) if not c) if any(f) else t
        expected[key, text, len(text or "")] += 1
    out = passages.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == expected


def test_suffix_array_against_brute_force(odd_docs, odd_texts):
    by_key = defaultdict(list)
    for (key, t), f in zip(odd_texts, covered([t for _, t in odd_texts], 50)):
        by_key[key, len(f)].append(f)
    for r in suffixes.summary(odd_docs).collect():
        mine = [False] * r.n_words
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split("-"))
            mine[a:b] = [True] * (b - a)
        assert sum(mine) == r.n_repeated and mine in by_key[r.doc_id, r.n_words]


@pytest.mark.parametrize("settings", [suffixes.Settings(), suffixes.Settings(held=4)])
def test_suffix_array_finds_repeats_whose_end_is_common(spark, settings):
    """Two documents share a passage whose last words stand in many others, which sort between them."""
    rng = random.Random(11)
    texts = []
    for case in range(60):
        def prose(n):
            return [f"{case}x{rng.randrange(10**6)}" for _ in range(n)]
        size = rng.randint(50, 80)
        passage = prose(size)
        texts += [prose(rng.randint(0, 30)) + passage + prose(rng.randint(0, 80)) for _ in range(2)]
        for _ in range(10):
            tail = rng.randint(20, 49) if case % 2 else 40
            texts.append(prose(rng.randint(0, 80)) + passage[-tail:] + prose(rng.randint(0, 80)))
    texts = [" ".join(t) for t in texts]
    texts += ["p " + texts[0], "p q " + texts[0]]   # more of the same place
    expected = covered(texts, 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in suffixes.summary(df, settings).collect():
        mine = [False] * r.n_words
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split("-"))
            mine[a:b] = [True] * (b - a)
        assert mine == expected[r.doc_id]


def test_empty_tables(no_docs):
    for df in (digest_index.deduplicate(no_docs), hyperminhash.near_duplicates(no_docs), passages.summary(no_docs),
               suffixes.summary(no_docs), passages.without_repeats(no_docs), hyperminhash.keep_one(no_docs),
               digest_index.without_copies(no_docs)):
        assert df.collect() == []


def test_rows_that_stay(odd_docs, odd_texts):
    exact = digest_index.without_copies(odd_docs)
    assert exact.columns == odd_docs.columns
    assert exact.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in odd_texts})
    near = hyperminhash.keep_one(odd_docs)
    assert near.columns == odd_docs.columns
    assert near.count() == sum(r.kept for r in hyperminhash.near_duplicates(odd_docs).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[70] == got[50] == 50 and got[201] == 200
    assert 300 not in got
