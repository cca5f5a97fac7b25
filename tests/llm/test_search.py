"""Nearest neighbours and URL lists against brute force; the registered queries and the pipeline."""
import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import block_ann, catalog, url_lists

SF = "/root/testdata/sf0.001"


def nearest(rows, k, of):
    usable = [(n, i, v) for n, (i, v) in enumerate(rows)
              if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in usable:
        if i is None or i % of:
            continue
        scored = [(-float(np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w))), j if j is not None else math.inf)
                  for m, j, w in usable if m != n and len(w) == len(v)]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted((round(s, 12), j) for s, j in scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 16384), (4, 9)])
def test_neighbours_against_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(20)]                    # many equal vectors
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] + [1.0] * 7),
             (305, [float("inf")] + [1.0] * 7), (306, [1.0, 2.0]), (310, [2.0, 1.0]), (10, rows[3][1]), (None, rows[20][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, row string, score int")
    got = block_ann.neighbours(df, F.col("vec_id") % 10 == 0, 5, query_block=blocks[0], candidate_block=blocks[1]).collect()
    mine = sorted((r.query_id, r.rank, math.inf if r.vec_id is None else r.vec_id, round(-r.score, 12)) for r in got)
    assert mine == nearest(rows, 5, 10)


def test_int8_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 32)) * rng.uniform(0.01, 50, (300, 1))
    b = block_ann.Block(np.arange(300), np.arange(300), v)
    near, off = block_ann.bounds(b, slice(0, 300), b, slice(0, 300))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert (np.abs(near - u @ u.T) <= off).all() and off.max() < 0.05


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert block_ann.neighbours(df, F.col("vec_id") % 50 == 0).collect() == []


def test_url_lists_against_brute_force(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [("bad", False, "domain", "Evil.example.com", day(10), "add"), ("bad", False, "domain", "evil.example.com", day(20), "remove"),
               ("bad", False, "domain", "evil.example.com", day(30), "add"), ("bad", False, "domain", "evil.example.com", day(30), "add"),
               ("legal", False, "prefix", "ok.org/a/b", day(0), "add"), ("good", True, "domain", "www.evil.example.com", day(35), "add"),
               ("bad", None, "domain", "gone.org", day(5), "add"), ("bad", False, "domain", "gone.org", day(5), "remove"),
               (None, False, "domain", "ok.org", day(0), "add"), ("bad", False, None, "ok.org", day(0), "add")]
    captures = [(1, "http://evil.example.com/x", day(9)), (2, "http://evil.example.com/x", day(10)), (3, "https://www.EVIL.example.com", day(19)),
                (4, "http://evil.example.com", day(20)), (5, "http://sub.evil.example.com:80/q?x=1", day(31)), (6, "http://www.evil.example.com/", day(36)),
                (7, "http://ok.org/a/b/c.html", day(1)), (8, "http://ok.org/a", day(1)), (9, None, day(1)), (10, "not a url", day(40)),
                (11, "http://evil.example.com", None), (12, "http://gone.org/", day(6)), (13, "http://u:p@evil.example.com/x", day(31)),
                (13, "http://fine.org", day(31))]
    got = sorted((r.id, r.blocked, r.lists) for r in url_lists.judge(
        spark.createDataFrame([(*c, "key") for c in captures], "id long, url string, day date, key string"),
        spark.createDataFrame(entries, "list string, allow boolean, kind string, pattern string, day date, action string")).collect())
    assert got == [(1, False, ""), (2, True, "bad"), (3, True, "bad"), (4, False, ""), (5, True, "bad"), (6, False, "bad,good"),
                   (7, True, "legal"), (8, False, ""), (9, False, ""), (10, False, ""), (11, False, ""), (12, False, ""),
                   (13, False, ""), (13, True, "bad")]
    cased = spark.createDataFrame([("shop", False, "prefix", "EX.com/Products", day(0), "add")], "list string, allow boolean, kind string, pattern string, day date, action string")
    asked = spark.createDataFrame([(1, "http://ex.com/Products/a", day(1)), (2, "http://Ex.com/products/a", day(1))], "id long, url string, day date")
    assert {r.id: r.blocked for r in url_lists.judge(asked, cased).collect()} == {1: True, 2: False}
    none = spark.createDataFrame([], "list string, allow boolean, kind string, pattern string, day date, action string")
    assert not any(r.blocked for r in url_lists.judge(
        spark.createDataFrame(captures, "id long, url string, day date"), none).collect())


def _oracle(sql):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(str(sorted(zip(names, (round(v, 9) if isinstance(v, float) else v for v in row)))) for row in cur.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    mine = sorted(str(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in rows)
    assert mine == _oracle(catalog.oracle_sql()[name])


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        if i < 4:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]
