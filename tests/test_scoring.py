"""Points rules, status bands, suites and invariants."""
import pytest
from pyspark.sql import functions as F

from veracity.plans import scoring as sc
from veracity.plans.spec import POLICIES, CheckSpec, default_suite
from veracity.plans.suite import run_suite

RATES = [0, 89.99, 90, 90.01, 95, 95.01, 98, 99.5, 100]


def points(spark, sql_fn, possible):
    df = spark.createDataFrame([(float(r),) for r in RATES], "rate double")
    return [r[0] for r in df.select(F.expr(sql_fn(repr(float(possible)), "rate"))).collect()]


def test_points_strict(spark):
    assert points(spark, sc.points_strict_sql, 10) == [0, 0, 0, 6, 6, 10, 10, 10, 10]
    assert points(spark, sc.points_strict_sql, 2.5)[-1] == 2.0      # truncated
    assert points(spark, sc.points_strict_sql, 7)[3] == 4.0          # int(4.2)


def test_points_tiered_half_even(spark):
    assert points(spark, sc.points_tiered_sql, 5) == [0, 0, 3, 3, 5, 5, 5, 5, 5]
    assert points(spark, sc.points_tiered_sql, 2.5)[2] == 2.0        # round(1.5) -> 2
    assert points(spark, sc.points_tiered_sql, 7)[2] == 4.0          # round(4.2) -> 4


def test_points_linear_and_all_or_nothing(spark):
    assert points(spark, sc.points_linear_sql, 10)[3] == pytest.approx(9.001)
    assert points(spark, lambda p, r: sc.points_all_or_nothing_sql(p, r, 98.0), 4) == [0] * 6 + [4] * 3


def test_points_threshold(spark):
    got = points(spark, lambda p, r: sc.points_threshold_sql(r, ((98, 3), (95, 2), (90, 1))), 3)
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_status_bands(spark):
    df = spark.createDataFrame([(s,) for s in (64.9, 65.0, 75.0, 85.0, 95.0)], "s double")
    assert [r[0] for r in df.select(sc.status_band(F.col("s"))).collect()] == \
        ["CRITICAL", "POOR", "FAIR", "GOOD", "EXCELLENT"]


def claims(spark):
    rows = [("P1", "C1", "2024-01-05", " Closed ", 0.0, 5.0, 5.0), ("P2", "C2", "2024-01-06", "Open", 3.0, 2.0, 5.0),
            (None, "C2", "bad", None, None, -1.0, 1.0)]
    return spark.createDataFrame(rows, "policy_number string, claim_number string, accident_date string, "
                                       "claim_status string, total_os double, total_paid double, "
                                       "total_incurred double")


def test_suite_skips_and_missing_columns(spark):
    df = claims(spark)
    v5 = run_suite(default_suite(include_risk=True), POLICIES["v5"], df).checks
    rows = {r.check_id: r for r in v5.collect()}
    assert rows["6.1"].skipped and rows["6.1"].points_earned == 4 and rows["6.1"].pass_rate == 100
    assert rows["8.1"].skipped and rows["8.1"].points_earned == 10
    assert rows["1.5"].error == "column not found: uw_date" and rows["1.5"].total == 3 and rows["1.5"].failed == 0
    assert rows["1.3"].passed == 2                                   # unparsable date is null
    v4 = {r.check_id: r for r in run_suite(default_suite(), POLICIES["v4"], df).checks.collect()}
    assert v4["6.1"].skipped and v4["6.1"].points_earned == 0
    v2 = {r.check_id for r in run_suite(default_suite(include_risk=True), POLICIES["v2"], df).checks.collect()}
    assert "8.1" not in v2                                           # omitted without a reference table


def test_unknown_check_type_is_an_error_row(spark):
    spec = CheckSpec("9.9", "Mystery", "no_such_check", "X", "Y", 5)
    r = run_suite([spec], POLICIES["v5"], claims(spark)).checks.collect()[0]
    assert r.error == "Unknown check type: no_such_check" and r.points_earned == 0


def test_invariants_and_partition_independence(spark):
    from veracity.catalog import v5_run
    run = v5_run(spark, "/root/testdata/sf0.001")
    rows = run.checks.collect()
    for r in rows:
        if not r.error:
            assert r.passed + r.failed == r.total
        assert r.points_earned <= r.points_possible
    cats = run.categories().agg(F.sum("points_earned")).collect()[0][0]
    assert cats == pytest.approx(run.score().collect()[0].overall_score)
    from veracity.sources import fixtures as fx
    cur = fx.claims_snapshot(spark, "/root/testdata/sf0.001", True)
    prev = fx.claims_snapshot(spark, "/root/testdata/sf0.001", False)
    a = run_suite(default_suite(), POLICIES["v5"], cur.repartition(1), prev.repartition(3)).checks
    b = run_suite(default_suite(), POLICIES["v5"], cur.repartition(7), prev.repartition(2)).checks
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_auto_disable_reasons():
    from veracity.functions.text import parse_closed_values
    from veracity.plans.spec import auto_disable
    specs, why = auto_disable(default_suite(include_risk=True), {"policy_number", "claim_number", "total_paid"},
                              previous_available=False, reference_available=False)
    assert why["1.3"] == "Missing/unmapped columns: accident_date"
    assert why["3.3"] == "Missing/unmapped columns: total_incurred, total_os"
    assert why["6.1"].startswith("Previous bdx month not available")
    assert why["8.1"] == "Risk database not selected"
    assert {s.id for s in specs if s.enabled} == {"1.1", "1.2", "2.2", "4.1"}
    assert parse_closed_values(" Closed, ,C ,") == ["Closed", "C"]


def test_materialize_checkpoints_into_configured_dir(spark):
    import os
    from veracity.catalog import v5_run
    from veracity.session import checkpoint_dir
    run = v5_run(spark, "/root/testdata/sf0.001")
    before = sorted(map(tuple, run.checks.collect()))
    folder = checkpoint_dir(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or folder)
    run.materialize()
    assert sorted(map(tuple, run.checks.collect())) == before
    path = folder[len("file:"):] if folder.startswith("file:") else folder
    assert any(files for _, _, files in os.walk(path))
    # reports built on the checkpointed results no longer carry the scan lineage
    plan = run.score()._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in plan
