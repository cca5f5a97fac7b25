"""Failing claim numbers from the groupings of the key profile, and runs that evaluate them once."""
import tempfile

import pytest

from veracity import catalog_arrivals
from veracity.plans import reports as rp
from veracity.plans.runstore import RunStore
from veracity.plans.spec import POLICIES, CheckSpec
from veracity.plans.suite import run_suite

KEY_CHECKS = [CheckSpec(i, i, t, "c", "s", 1, field="claim_number") for i, t in (
    ("u", "unique"), ("m", "missing_claims_from_prev_month"), ("p", "total_paid_non_decreasing_vs_prev"))]
NOW = [("a", 1.0), ("a", 2.0), ("a", 0.0), (None, 1.0), (None, 2.0), ("b", 1.0), ("c", None), ("d", 5.0), ("", 1.0)]
THEN = [("a", 3.0), ("b", 2.0), ("b", 1.0), ("c", 1.0), ("e", 1.0), ("e", 2.0), (None, 9.0), ("f", None), ("", None)]


def _run(spark, specs=None, where=None):
    sides = [spark.createDataFrame(rows, "claim_number string, total_paid double") for rows in (NOW, THEN)]
    if where:
        for i, side in enumerate(sides):
            side.write.parquet(f"{where}/claims{i}")
            sides[i] = spark.read.parquet(f"{where}/claims{i}")
    return run_suite(specs or KEY_CHECKS, POLICIES["v5"], *sides)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_limited_records_are_the_first_of_all(spark):
    run = _run(spark)
    every = [tuple(r) for r in rp.failed_records(run, limit=None).collect()]
    assert {c for c, _ in every} == {"u", "m", "p"} and every.count(("u", None)) == 2 and every.count(("u", "a")) == 3
    for limit in (1, 2, 100):
        kept = [tuple(r) for r in rp.failed_records(run, limit=limit).collect()]
        first = [e for c in "ump" for e in sorted((e for e in every if e[0] == c), key=lambda e: (e[1] is not None, e[1] or ""))[:limit]]
        assert sorted(map(str, kept)) == sorted(map(str, first))


def test_no_failing_keys_without_a_previous_snapshot(spark):
    cur = spark.createDataFrame(NOW, "claim_number string, total_paid double")
    run = run_suite(KEY_CHECKS, POLICIES["v5"], cur)
    assert {r.check_id for r in rp.failed_records(run).collect()} == {"u"}


def test_key_checks_share_one_grouping_a_snapshot(spark):
    # one exchange a snapshot and that of the window
    assert _plan(rp.failed_records(_run(spark))).count("Exchange hashpartitioning(") == 3


def test_a_saved_run_is_evaluated_once(spark):
    where = tempfile.mkdtemp(prefix="run-once-", dir="/tmp")
    run = _run(spark, where=where)
    expected = sorted(map(str, rp.dq_check_results(run, "q", "2024-01-01 00:00:00").collect()))
    store = RunStore(spark, f"{where}/store")
    store.save(run, "q", "2024-01-01 00:00:00")
    assert "claims0" not in _plan(rp.dq_check_results(run, "q", "2024-01-01 00:00:00"))
    assert sorted(map(str, store.read("dq_check_results").select(*rp.dq_check_results(run, "q", "2024-01-01 00:00:00").columns).collect())) == expected


@pytest.mark.parametrize("name", ["stored_runs", "stored_scores"])
def test_each_snapshot_is_joined_once(spark, name, monkeypatch):
    """Runs after the first read the stored snapshot."""
    from veracity import catalog
    module, seen = (catalog_arrivals, []) if name == "stored_runs" else (catalog, [])
    real = module.run_suite

    def spy(specs, policy, current, previous=None, *more, **kw):
        run = real(specs, policy, current, previous, *more, **kw)
        seen.append((run.current, run.previous))
        return run
    monkeypatch.setattr(module, "run_suite", spy)
    getattr(module, name)(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3
    for frame in (f for pair in seen for f in pair if f is not None):
        assert "Join" not in _plan(frame)
