"""Every snapshot in one job equals month-by-month runs."""
import datetime as dt

from veracity.plans.history import run_suite_by_snapshot, scores_by_snapshot
from veracity.plans.spec import POLICIES, default_suite
from veracity.plans.suite import run_suite

COLS = "bdx_month timestamp_ntz, claim_number string, policy_number string, total_paid double, total_os double"


def history(spark):
    m1, m2, m3 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))
    rows = [(m1, "a", "P1", 5.0, 0.0), (m1, "b", "P2", 1.0, 0.0), (m1, None, "P3", 2.0, None),
            (m2, "a", "P1", 6.0, 0.0), (m2, "c", None, 1.0, -1.0), (m2, "c", "P1", 2.0, 0.0),
            (m3, "a", "P1", 4.0, 0.0), (m3, "c", "P9", 3.0, 0.0), (m3, "d", "P1", None, 1.0)]
    return spark.createDataFrame(rows, COLS)


def test_grouped_equals_monthly(spark):
    hist = history(spark)
    risk = spark.createDataFrame([("P1",), ("P2",)], "risk_policy_number string")
    for policy in ("v5", "v4", "v1"):
        pol = POLICIES[policy]
        grouped = run_suite_by_snapshot(default_suite(include_risk=True), pol, hist, "bdx_month", risk, ["Closed"],
                                        2024)
        got = {(r.snapshot, r.check_id): tuple(r)[1:] for r in grouped.collect()}
        snaps = sorted({k[0] for k in got})
        for i, s in enumerate(snaps):
            cur = hist.where(hist.bdx_month == s).drop("bdx_month")
            prev = hist.where(hist.bdx_month == snaps[i - 1]).drop("bdx_month") if i else None
            monthly = run_suite(default_suite(include_risk=True), pol, cur, prev, risk, ["Closed"], 2024).checks
            for r in monthly.collect():
                assert got[(s, r.check_id)] == tuple(r), (policy, s, r.check_id)
    scores = scores_by_snapshot(grouped, POLICIES["v1"]).orderBy("snapshot").collect()
    assert scores[0].previous_score is None and scores[1].score_change is not None
