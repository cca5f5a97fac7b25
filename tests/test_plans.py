"""Physical-plan properties that the design relies on at scale."""
import os
import re
import tempfile


from veracity.plans.spec import POLICIES, default_suite
from veracity.plans.suite import run_suite
from veracity.sources import fixtures as fx
from veracity.sources import snapshots as sn

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_claims(spark):
    root = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp")
    fx.claims_history(spark, SF).write.partitionBy("bdx_month").parquet(os.path.join(root, "claims"))
    fx.risk_table(spark, SF).write.parquet(os.path.join(root, "risk"))
    return spark.read.parquet(os.path.join(root, "claims")), spark.read.parquet(os.path.join(root, "risk"))


def test_suite_plan_prunes_and_never_crosses(spark):
    claims, risk = stored_claims(spark)
    cur = sn.load_snapshot(claims, fx.CURRENT_BDX, "bdx_month")
    prev = sn.load_snapshot(claims, fx.PREVIOUS_BDX, "bdx_month")
    run = run_suite(default_suite(include_risk=True), POLICIES["v5"], cur, prev, risk, ["Closed"], 2002)
    plan = plan_text(run.checks)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    claim_scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "bdx_month" in line]
    assert claim_scans and all("PartitionFilters: [isnotnull(bdx_month" in line for line in claim_scans)
    # one scan of the current snapshot for all row checks, one per snapshot for the key profile,
    # one for the reference check: four claims scans in all, each reading only what it needs
    assert len(claim_scans) == 4, claim_scans
    narrow = [line for line in claim_scans if re.search(r"ReadSchema: struct<claim_number:string,total_paid:double>", line)]
    assert len(narrow) == 2


def test_row_checks_share_one_aggregate(spark):
    cur = fx.claims_snapshot(spark, SF, True)
    run = run_suite([s for s in default_suite() if s.type not in ("unique", "missing_claims_from_prev_month",
                                                               "total_paid_non_decreasing_vs_prev")],
                    POLICIES["v5"], cur)
    plan = plan_text(run.checks)
    assert plan.count("FileScan parquet") == 2                                     # lineitem and orders once each
    assert plan.count("HashAggregate(keys=[]") == 2                                # partial + final of ONE aggregate
    assert "Generate inline" in plan


def test_no_python_udfs_in_suite(spark):
    cur = fx.claims_snapshot(spark, SF, True)
    prev = fx.claims_snapshot(spark, SF, False)
    plan = plan_text(run_suite(default_suite(), POLICIES["v5"], cur, prev).checks)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_bucketed_history_needs_no_shuffle_for_the_key_profile(spark):
    from veracity.operators import keychecks as kc
    root = tempfile.mkdtemp(prefix="run-bucketed-", dir="/tmp")
    hist = sn.store_history(fx.claims_history(spark, SF), "veracity_claims_bucketed", os.path.join(root, "t"),
                            buckets=8)
    cur = sn.load_snapshot(hist, fx.CURRENT_BDX, "bdx_month")
    prev = sn.load_snapshot(hist, fx.PREVIOUS_BDX, "bdx_month")
    prof = kc.key_profile(cur, prev, "claim_number", "total_paid")
    plan = plan_text(prof)
    assert "Exchange hashpartitioning" not in plan, plan
    # same numbers as over the unbucketed views
    ref = kc.key_profile(fx.claims_snapshot(spark, SF, True), fx.claims_snapshot(spark, SF, False),
                         "claim_number", "total_paid")
    assert tuple(prof.collect()[0]) == tuple(ref.collect()[0])


def test_loss_ratio_filters_claims_by_reference_keys(spark):
    from veracity.operators import keychecks as kc
    from veracity.session import filter_joins_at_runtime
    root = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp")
    fx.claims_root(spark, SF).write.parquet(f"{root}/claims")
    fx.risk_table(spark, SF).write.parquet(f"{root}/risk")
    own = spark.newSession()
    claims, risk = own.read.parquet(f"{root}/claims"), own.read.parquet(f"{root}/risk")
    expected = kc.loss_ratio(claims, risk).first()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")             # as with a reference table of any size
    filter_joins_at_runtime(own, "10MB", "1")
    filtered = kc.loss_ratio(claims, risk)
    plan = plan_text(filtered)
    assert "might_contain" in plan and "bloom_filter_agg" in plan
    below = plan[plan.index("partial_sum"):]                               # the filter lies under the first aggregate of the claims
    assert "might_contain" in below[:below.index("FileScan")]
    assert filtered.first() == expected
