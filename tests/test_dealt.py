"""Claims and their keys go to more partitions as the lines grow, so that a task's orders and keys don't grow with them."""
import datetime
import random
import re
import tempfile

import pytest

from veracity import catalog
from veracity.operators import keychecks as kc
from veracity.plans.spec import POLICIES, default_suite
from veracity.plans.suite import run_suite
from veracity.sources import fixtures as fx

CLAIMS = "claim_number string, total_paid double"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark):
    root, day = tempfile.mkdtemp(prefix="run-dealt-", dir="/tmp"), datetime.datetime(1995, 1, 1)
    lines = [(i // 3, i, i % 60, i % 4, float(i % 7), "NRA"[i % 3], day) for i in range(330)]
    spark.createDataFrame(lines + lines[:20] + [(None, 1, 1, 1, 1.0, "A", day)] * 3,
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                          "l_shipdate timestamp_ntz").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(i, i % 30, day) for i in range(100)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz") \
        .write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(i, i - 4.0) for i in range(40)], "c_custkey long, c_acctbal double").write.parquet(f"{root}/customer.parquet")
    return root


def test_parts_grow_with_the_lines(spark, tables, monkeypatch):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fx.claim_parts(spark, tables) == few
    monkeypatch.setattr(fx, "LINES_A_TASK", 10)
    assert fx.claim_parts(spark, tables) == 36                                  # 353 lines
    assert fx.claims_snapshot(spark, tables, True).rdd.getNumPartitions() == 36


@pytest.mark.parametrize("name", ["report_risk", "dq_check_results"])
def test_same_rows_from_more_parts(spark, tables, monkeypatch, name):
    query = catalog.REGISTRY[name][0]

    def rows():
        return sorted(map(str, query(spark, tables).collect()))
    usual = rows()
    monkeypatch.setattr(fx, "LINES_A_TASK", 353 // (int(spark.conf.get("spark.sql.shuffle.partitions")) + 2))
    assert rows() == usual and usual


def test_claim_keys_of_a_run_are_dealt_once_into_its_parts(spark):
    cur = spark.createDataFrame([(None, 1.0), ("a", 5.0), ("b", 1.0)], CLAIMS)
    prev = spark.createDataFrame([(None, 9.0), ("a", 5.0), ("x", 1.0)], CLAIMS)
    dealt = r"Exchange hashpartitioning\((?:k|h|b)\S*(?:, \S+)?, 19\)"
    keys = [s for s in default_suite() if s.type in ("unique", "missing_claims_from_prev_month", "total_paid_non_decreasing_vs_prev")]
    left = plan_text(run_suite(keys, POLICIES["v5"], cur, prev, key_parts=19).checks)
    assert left.count("Exchange hashpartitioning") == len(re.findall(dealt, left)) == 1
    pairs = plan_text(kc.paid_not_decreasing_rows(cur, prev, "claim_number", "total_paid", parts=19))
    # reduced rows of cuts and windows, once more for the windows; hot keys' buckets are few
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*, 19\)", pairs)) >= 3
    for group in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", pairs):
        assert group.endswith(", 19") or not re.match(r"k#\d+, v#", group)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ", 3)" not in plan_text(kc.key_profile(cur, prev, "claim_number", "total_paid", parts=min(3, usual)))


def test_dealt_keys_count_like_the_others(spark):
    rng = random.Random(8)

    def side(n):
        return spark.createDataFrame([(rng.choice([None, "", "hot", "hot", f"k{rng.randrange(200)}"]),
                                       rng.choice([None, 0.0, -0.0, float("nan"), float(rng.randrange(9))])) for _ in range(n)], CLAIMS).cache()
    cur, prev = side(600), side(500)
    for before in (prev, None):
        usual, dealt = (kc.key_profile(cur, before, "claim_number", "total_paid", parts=p).first() for p in (None, 31))
        assert usual == dealt
    for buckets in (128, 3):
        usual, dealt = (tuple(kc.paid_not_decreasing_rows(cur, prev, "claim_number", "total_paid", buckets, p).first()) for p in (None, 31))
        assert usual == dealt and usual[0] > 0
    for shared in (False, True):
        usual, dealt = (sorted(map(str, kc.failing_records(cur, prev, "claim_number", "total_paid", ["u"], ["m"], ["p"], 100, shared, p).collect()))
                        for p in (None, 31))
        assert usual == dealt
