"""Checks over text columns, isolated errors, stable sums, policies, limits and stored runs."""
import tempfile

import pytest
from pyspark.sql import functions as F

from veracity.functions.text import closed_exact, pass_rate_text
from veracity.operators import keychecks as kc
from veracity.operators import rowchecks as rc
from veracity.plans import reports as rp
from veracity.plans.config import flat_spec
from veracity.plans.history import run_suite_by_snapshot
from veracity.plans.spec import POLICIES, CheckSpec, default_suite, suite_root
from veracity.plans.suite import run_suite
from veracity.sources import snapshots as sn


def counts(df, check):
    return df.agg(F.count_if(check.scope), F.count_if(check.scope & F.coalesce(check.ok, F.lit(False)))).first()


def test_expressions_compare_text_by_value(spark):
    df = spark.createDataFrame([("9", "10", "0"), ("10", "9", "2"), ("bad", "1", "1"), (None, "1", "x")],
                               "total_incurred string, total_paid string, other string")
    cols = rc.Cols(df)
    assert tuple(counts(df, rc.expression(cols, "total_incurred >= total_paid"))) == (4, 1)
    assert tuple(counts(df, rc.expression(cols, "total_paid / other > 4", value_kind="number"))) == (4, 1)
    assert tuple(counts(df, rc.expression(cols, "total_paid / (other - 0) > 4", value_kind="number"))) == (4, 1)
    assert tuple(counts(df, rc.expression(cols, "other = 'x'"))) == (4, 1)


def test_bad_checks_stay_alone(spark):
    df = spark.createDataFrame([("a", 1.0)], "claim_number string, total_paid double")
    meta = ("Rules", "Declared", 5)
    specs = [CheckSpec("1", "ok", "not_null", *meta, field="claim_number"), CheckSpec("2", "no field", "non_negative", *meta),
             CheckSpec("3", "unknown", "expression", *meta, predicate="nope > 1"),
             CheckSpec("4", "text", "expression", *meta, predicate="total_paid +"),
             CheckSpec("5", "type", "telepathy", *meta)]
    got = {r.check_id: r for r in run_suite(specs, POLICIES["v5"], df).checks.collect()}
    assert got["1"].points_earned == 5 and got["1"].error is None
    assert all(got[i].points_earned == 0 and got[i].error for i in "2345")
    history = run_suite_by_snapshot(specs, POLICIES["v5"], df.withColumn("bdx_month", F.lit("2024-01")))
    assert {r.check_id: (r.points_earned, bool(r.error)) for r in history.collect()} == \
        {k: (r.points_earned, bool(r.error)) for k, r in got.items()}


def test_blanks_and_statuses_of_any_white_space(spark):
    df = spark.createDataFrame([("\t\n", "\tClosed\n"), (" ", "open"), ("x", " closed "), (None, None)],
                               "claim_number string, claim_status string")
    assert tuple(counts(df, rc.not_null(rc.Cols(df), "claim_number"))) == (4, 1)
    assert df.select(closed_exact(F.col("claim_status"), ["Closed"]).alias("c")).where("c").count() == 2


def test_coercion_by_profile(spark):
    df = spark.createDataFrame([("bad", "7"), ("2024-01-05", "x")], "accident_date string, total_paid string")
    for policy, expected in (("v5", 1), ("v2", 1), ("root", 2)):
        check = rc.not_null(rc.Cols(df, coerce=POLICIES[policy].coerce), "accident_date", False)
        assert counts(df, check)[1] == expected


def test_paid_sums_do_not_depend_on_row_order(spark):
    cur = spark.createDataFrame([("k", 0.1), ("k", 0.2), ("k", 0.3)], "claim_number string, total_paid double").coalesce(1)
    prev = spark.createDataFrame([("k", 0.3), ("k", 0.2), ("k", 0.1)], "claim_number string, total_paid double").coalesce(1)
    for a, b in ((cur, prev), (prev, cur)):
        assert tuple(kc.paid_not_decreasing(a, b, "claim_number", "total_paid").first()) == (1, 1, 0)
        assert kc.failing_paid_keys(a, b, "claim_number", "total_paid").count() == 0
    less = prev.withColumn("total_paid", F.col("total_paid") - 0.001)
    assert kc.paid_not_decreasing(less, cur, "claim_number", "total_paid").first().failed == 1


def test_pairwise_rows_fail_with_their_pairs(spark):
    cur = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", None), (None, 2.0), ("new", 1.0)], "k string, v double")
    prev = spark.createDataFrame([("a", 3.0), ("b", 1.0), (None, 2.0)], "k string, v double")
    assert sorted(map(str, kc.failing_paid_rows(cur, prev, "k", "v").collect())) == ["Row(k='a', v=1.0)", "Row(k='b', v=None)"]
    assert tuple(kc.paid_not_decreasing_rows(cur, prev, "k", "v").first()) == (4, 2, 2)


def test_planning_the_pairwise_check_runs_no_job(spark):
    cur = spark.range(10).selectExpr("cast(id as string) as k", "cast(id as double) as v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "planning")
    kc.paid_not_decreasing_rows(cur, cur, "k", "v")
    assert len(tracker.getJobIdsForGroup("plan-only")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pass_rate_ties(spark):
    values = [6.25, 6.75, 98.25, 0.15, 0.25, 0.35, 99.95, 100.0, 0.0, 33.333333333333336, 2.675, 66.65, 12.05, 97.45]
    got = spark.createDataFrame([(v,) for v in values], "r double").select("r", pass_rate_text(F.col("r")).alias("t")).collect()
    assert {r.r: r.t for r in got} == {v: f"{v:.1f}%" for v in values}


def test_reference_key_by_policy(spark):
    claims = spark.createDataFrame([("p",), ("q",)], "policy_number string")
    risk = spark.createDataFrame([("p",)], "nothing_known string")
    spec = [CheckSpec("8.1", "risk", "risk_policy_match", "Risk", "Cross", 10)]
    for policy, expected in (("v5", (2, 0, 2)), ("v4", (0, 0, 0)), ("v1", (0, 0, 0))):
        r = run_suite(spec, POLICIES[policy], claims, None, risk).checks.first()
        assert (r.total, r.passed, r.failed) == expected and r.error
        h = run_suite_by_snapshot(spec, POLICIES[policy], claims.withColumn("bdx_month", F.lit("m")), "bdx_month", risk).first()
        assert (h.total, h.passed, h.failed) == expected and h.error


def test_history_equals_single_runs_without_columns(spark):
    rows = [("c1", "p1", 5.0, "2024-01"), ("c2", "p2", 1.0, "2024-01"), ("c1", "p1", 4.0, "2024-02"), ("c3", None, 2.0, "2024-02")]
    history = spark.createDataFrame(rows, "claim_number string, policy_number string, total_paid double, bdx_month string")
    risk = spark.createDataFrame([("p1",)], "policy_ref string")
    specs = [s if s.id != "8.1" else CheckSpec(**{**s.__dict__, "risk_key": "policy_ref"}) for s in default_suite(include_risk=True)]
    for gone in ([], ["total_paid"], ["claim_number"], ["policy_number"]):
        h = history.drop(*gone)
        got = {(r.snapshot, r.check_id): (r.total, r.passed, r.failed, r.points_earned, r.skipped, r.error)
               for r in run_suite_by_snapshot(specs, POLICIES["v5"], h, "bdx_month", risk).collect()}
        prev = None
        for month in ("2024-01", "2024-02"):
            cur = h.where(F.col("bdx_month") == month).drop("bdx_month")
            run = run_suite(specs, POLICIES["v5"], cur, prev, risk)
            for r in run.checks.collect():
                assert got[month, r.check_id] == (r.total, r.passed, r.failed, r.points_earned, r.skipped, r.error), (gone, month, r)
            prev = cur


def test_many_snapshots_raise(spark, monkeypatch):
    monkeypatch.setattr(sn, "MOST_SNAPSHOTS", 5)
    df = spark.range(8).selectExpr("id as bdx_month")
    with pytest.raises(Exception, match="is it a snapshot column"):
        sn.previous_snapshots(df).collect()


def test_flat_overrides():
    s = flat_spec({"id": "3.1", "type": "closed_os_zero", "points": 10, "os_field": "reserve",
                   "closed_status_values": ["Closed"], "high_pass_rate": 99, "mid_points_factor": 0.5})
    assert s.fields == ("claim_status", "reserve") and s.closed_values == ("Closed",)
    assert (s.high_pass_rate, s.mid_pass_rate, s.mid_points_factor) == (99.0, 90.0, 0.5)
    assert flat_spec({"id": "7.1", "type": "total_paid_non_decreasing_vs_prev", "claim_field": "c", "paid_field": "p"}).paid == "p"


def test_trend_takes_the_latest_run(spark):
    rows = [("l", "q1", 50.0, "2024-01-01"), ("l", "q2", 70.0, "2024-02-01"), ("l", "q2", 60.0, "2024-03-01")]
    got = rp.score_trend(spark.createDataFrame(rows, "business_line string, quarter_id string, overall_score double, run_timestamp string"))
    assert sorted(map(tuple, got.collect())) == [("l", "q1", 50.0, None, None), ("l", "q2", 60.0, 50.0, 10.0)]


def test_failing_records_cap(spark):
    df = spark.range(300).selectExpr("cast(id as string) as claim_number", "-1.0D as total_paid")
    run = run_suite([CheckSpec("2.2", "paid", "non_negative", "c", "s", 7, field="total_paid")], POLICIES["v5"], df)
    assert rp.failed_records(run).count() == 100 and rp.failed_records(run, limit=None).count() == 300
    assert [r.record for r in rp.failed_records(run, limit=2).collect()] == ["0", "1"]


def test_a_snapshot_split_over_batches_is_whole(spark):
    from veracity.streaming.arrivals import validate_batch
    root = tempfile.mkdtemp(prefix="run-split-", dir="/tmp")
    rows = lambda *cs, m: spark.createDataFrame([(c, 1.0, m) for c in cs], "claim_number string, total_paid double, bdx_month string")
    kw = dict(history_path=f"{root}/h", results_path=f"{root}/r", specs=default_suite(), policy=POLICIES["v5"], as_of_year=2002)
    validate_batch(rows("a", "b", "c", m="2024-01"), 0, **kw)
    validate_batch(rows("a", m="2024-02"), 1, **kw)
    validate_batch(rows("b", "c", m="2024-02"), 2, **kw)
    checks = spark.read.parquet(f"{root}/r/dq_check_results").where("quarter_id = '2024-02' and check_id = '6.1'").collect()
    assert [(r.total_count, r.failed_count) for r in checks] == [(3, 0)]


def test_checkpoint_folder(spark):
    from types import SimpleNamespace

    from veracity.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d)
    made = {}
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: made.get("dir"),
                         setCheckpointDir=lambda d: made.update(dir=d))
    with pytest.raises(ValueError, match="share"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
    made["dir"] = "hdfs://shared/x"
    assert checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf)) == "hdfs://shared/x"


def test_root_suite_by_snapshot_has_the_ratio_check(spark):
    claims = spark.createDataFrame([("p", "c1", 10.0, "m1"), ("p", "c2", 500.0, "m2")],
                                   "policy_number string, claim_number string, gross_incurred double, bdx_month string")
    risk = spark.createDataFrame([("p", 100.0)], "risk_policy_number string, gwp double")
    got = {r.snapshot: (r.total, r.passed) for r in run_suite_by_snapshot(
        suite_root(2002), POLICIES["root"], claims, "bdx_month", risk).where("check_id = '11.1'").collect()}
    assert got == {"m1": (1, 1), "m2": (1, 0)}
