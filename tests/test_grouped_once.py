"""Key checks and claims views that hold little per task: one grouping, no joins of all keys, one join of lines and orders."""
import datetime
import random
import tempfile
from collections import defaultdict

from veracity.operators import keychecks as kc
from veracity.sources import fixtures as fx

CLAIMS = "claim_number string, total_paid double"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_profile_groups_both_snapshots_once(spark):
    cur = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), ("b", 1.0), ("b", 1.0), ("c", None), ("d", 4.0)], CLAIMS)
    prev = spark.createDataFrame([(None, 9.0), ("a", 5.0), ("b", 3.0), ("c", 1.0), ("x", 1.0), ("x", 2.0), ("y", None)], CLAIMS)
    prof = kc.key_profile(cur, prev, "claim_number", "total_paid")
    plan = plan_text(prof)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    # all rows, rows of repeated keys, keys; previous keys and those still there; current keys and those not fallen
    assert tuple(prof.first()) == (7, 4, 5, 5, 3, 4, 2)
    for shared in (False, True):
        failing = kc.failing_records(cur, prev, "claim_number", "total_paid", ["u"], ["m"], ["p"], 100, shared)
        assert sorted(map(tuple, failing.collect()), key=str) == sorted(
            [("u", None), ("u", None), ("u", "b"), ("u", "b"), ("m", "x"), ("m", "y"), ("p", "b"), ("p", "c")], key=str)


def test_pairs_of_hot_warm_and_null_keys_without_a_join(spark):
    rng = random.Random(5)

    def rows(n):
        return [(rng.choice([None, "", "hot", "hot", f"k{rng.randrange(300)}"]),
                 rng.choice([None, 0.0, float(rng.randrange(40)), rng.random() * 90])) for _ in range(n)]
    cur, prev = rows(900), rows(700)
    of_key = defaultdict(list)
    for k, v in prev:
        of_key[k].append(v)
    pairs = [(v, w) for k, v in cur for w in of_key[k]]
    passed = sum(v is not None and w is not None and v >= w for v, w in pairs)
    for buckets in (128, 3):
        checked = kc.paid_not_decreasing_rows(spark.createDataFrame(cur, CLAIMS), spark.createDataFrame(prev, CLAIMS),
                                              "claim_number", "total_paid", buckets)
        assert "Join" not in plan_text(checked)
        assert tuple(checked.first()) == (len(pairs), passed, len(pairs) - passed)


def test_history_joins_lines_and_orders_once(spark):
    root, day = tempfile.mkdtemp(prefix="run-once-", dir="/tmp"), datetime.datetime(1995, 1, 1)
    spark.createDataFrame([(1, 40, 50, 1, 8.0, "N", day), (37, 3, 50, 2, 6.0, None, None), (2, None, None, None, None, "R", day), (None, 1, 1, 1, 1.0, "A", day),
                           (3, 1, 1, 1, 1.0, "A", day)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                          "l_shipdate timestamp_ntz").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(1, 7, day), (37, 8, day), (2, None, None), (None, 9, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz") \
        .write.parquet(f"{root}/orders.parquet")
    history = fx.claims_history(spark, root)
    assert plan_text(history).count("FileScan parquet") == 2
    assert sorted(map(tuple, history.selectExpr("string(bdx_month)", "claim_number", "total_paid", "total_incurred").collect()), key=str) == sorted([
        ("1998-01-01 00:00:00", "C1-1", 8.0, 9.0), ("1998-01-01 00:00:00", None, None, None), ("1998-02-01 00:00:00", "R1-1", 4.0, 5.0),
        ("1998-02-01 00:00:00", "R37-2", 6.0, 6.0), ("1998-02-01 00:00:00", None, None, None)], key=str)
    single = fx.claims_snapshot(spark, root, True)
    assert single.exceptAll(history.where(f"bdx_month = '{fx.CURRENT_BDX}'").drop("bdx_month")).isEmpty()
