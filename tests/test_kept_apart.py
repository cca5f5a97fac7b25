"""Claims views and key groupings whose tasks don't grow by merged partitions or sums that no check reads."""
import datetime
import tempfile

from veracity.operators import keychecks as kc
from veracity.sources import fixtures as fx

CLAIMS = "claim_number string, total_paid double"


def test_small_partitions_of_lines_and_orders_stay_apart(spark):
    root, day = tempfile.mkdtemp(prefix="run-apart-", dir="/tmp"), datetime.datetime(1995, 1, 1)
    spark.createDataFrame([(i, i, i, 1, 2.0, "N", day) for i in range(40)] + [(None, 1, 1, 1, 1.0, "A", day)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                          "l_shipdate timestamp_ntz").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(i // 2, i, day) for i in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz") \
        .write.parquet(f"{root}/orders.parquet")
    claims = fx.claims_snapshot(spark, root, True).select("claim_number", "policy_number")
    assert claims.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert claims.count() == 60                     # 30 lines have two orders each, the others none


def test_key_rows_without_paid_hold_no_sums(spark):
    cur = spark.createDataFrame([(None, 1.0), ("a", 5.0), ("b", 1.0), ("b", 1.0)], CLAIMS)
    prev = spark.createDataFrame([(None, 9.0), ("a", 5.0), ("x", 1.0)], CLAIMS)
    for before in (prev, None):
        plan = kc.key_rows(cur, before, "claim_number", None)._jdf.queryExecution().executedPlan().toString()
        assert "sum(" not in plan
    rows = kc.key_rows(cur, prev, "claim_number", None)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [(None, 1, None, None, False), ("a", 1, None, None, True), ("b", 2, None, None, False), ("x", None, None, None, True)], key=str)
    assert [f.dataType.simpleString() for f in rows.schema] == ["string", "bigint", "double", "double", "boolean"]
    profile = kc.key_profile(cur, prev, "claim_number", None).first()
    assert (profile.u_total, profile.u_failed, profile.u_groups, profile.m_total, profile.m_passed) == (4, 2, 3, 2, 1)
