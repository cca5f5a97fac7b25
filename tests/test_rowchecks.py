"""Row checks on hand tables: null, blank, NaN, unparsable, leap day, empty scope, absent column."""
import datetime as dt
import math

import pytest

from veracity.operators import rowchecks as rc
from veracity.catalog import check_frame


def run(df, chk):
    r = check_frame(df, chk).collect()[0]
    assert r.passed + r.failed == r.total
    return r.total, r.passed, r.failed, r.pass_rate


def strings(spark):
    return spark.createDataFrame([("a",), ("",), ("  ",), (None,)], "policy_number string")


def test_not_null_blank_fails(spark):
    df = strings(spark)
    assert run(df, rc.not_null(rc.Cols(df), "policy_number", True))[:3] == (4, 1, 3)
    assert run(df, rc.not_null(rc.Cols(df), "policy_number", False))[:3] == (4, 3, 1)


def numbers(spark):
    vals = ["1.0", "0.0", "-0.01", "NaN", None, "1,000", " 2 ", "n/a"]
    return spark.createDataFrame([(v,) for v in vals], "total_os string")


def test_numeric_coercion_and_non_negative(spark):
    df = numbers(spark)
    c = rc.Cols(df)
    # parsed: 1.0, 0.0, -0.01, (NaN->null), null, null, 2.0, null
    assert run(df, rc.non_negative(c, "total_os", "fail"))[:3] == (8, 3, 5)
    assert run(df, rc.non_negative(c, "total_os", "pass"))[:3] == (8, 7, 1)
    assert run(df, rc.non_negative(c, "total_os", "drop"))[:3] == (4, 3, 1)


def test_nan_double_is_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (-1.0,)], "total_os double")
    assert run(df, rc.non_negative(rc.Cols(df), "total_os", "fail"))[:3] == (4, 1, 3)


def dates(spark):
    vals = ["2024-01-05", "05/01/2024", "1900-01-01", "2024-13-01", "", None]
    return spark.createDataFrame([(v,) for v in vals], "uw_date string")


def test_valid_date_policies(spark):
    df = dates(spark)
    c = rc.Cols(df)
    assert run(df, rc.valid_date(c, "uw_date", "fail"))[:3] == (6, 3, 3)
    assert run(df, rc.valid_date(c, "uw_date", "pass"))[:3] == (6, 4, 2)
    assert run(df, rc.not_null_not_year_1900(c, "uw_date"))[:3] == (6, 2, 4)


def test_leap_day_policy_without_end(spark):
    schema = "accident_date timestamp_ntz, policy_start_date timestamp_ntz"
    start = dt.datetime(2024, 2, 29)
    df = spark.createDataFrame([(dt.datetime(2025, 2, 28), start), (dt.datetime(2025, 3, 1), start),
                                (None, start), (dt.datetime(2024, 3, 1), None)], schema)
    # v5: scope = loss not null (3); end = start + 1 year = 2025-02-28; null start fails
    assert run(df, rc.loss_within_policy(rc.Cols(df), rule="v5"))[:3] == (3, 1, 2)
    # row fallback: scope also needs a start
    assert run(df, rc.loss_within_policy(rc.Cols(df), rule="row_fallback"))[:3] == (2, 1, 1)


def test_loss_row_fallback_fills_null_end(spark):
    schema = "accident_date timestamp_ntz, policy_start_date timestamp_ntz, policy_end_date timestamp_ntz"
    s = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(dt.datetime(2020, 6, 1), s, None), (dt.datetime(2020, 6, 1), s,
                                                                      dt.datetime(2020, 3, 1))], schema)
    assert run(df, rc.loss_within_policy(rc.Cols(df), rule="row_fallback"))[:3] == (2, 1, 1)
    assert run(df, rc.loss_within_policy(rc.Cols(df), rule="no_fallback"))[:3] == (1, 0, 1)
    assert run(df, rc.loss_within_policy(rc.Cols(df), rule="v5"))[:3] == (2, 0, 2)


STATUSES = ["Closed", " CLOSED ", "Re-Closed", "Disclosed", "Open", None]


def statuses(spark):
    rows = [(s, o) for s in STATUSES for o in (0.0, 3.0, None)]
    return spark.createDataFrame(rows, "claim_status string, total_os double")


@pytest.mark.parametrize("match,os_null,expected", [
    ("word", "fail", (9, 3, 6)),
    ("substring", "pass", (12, 8, 4)),
    ("exact", "pass", (6, 4, 2)),
    ("case_sensitive", "fail", (3, 1, 2)),
])
def test_closed_matching(spark, match, os_null, expected):
    df = statuses(spark)
    chk = rc.closed_os_zero(rc.Cols(df), "claim_status", "total_os", ["Closed"], match, os_null)
    assert run(df, chk)[:3] == expected


def test_closed_empty_scope_passes(spark):
    df = spark.createDataFrame([("Open", 1.0)], "claim_status string, total_os double")
    assert run(df, rc.closed_os_zero(rc.Cols(df), "claim_status", "total_os", ["Closed"]))[3] == 100.0


def test_formula_and_empty_scope(spark):
    df = spark.createDataFrame([(10.0, 4.0, 6.0), (10.0, 4.0, 1.0), (None, 1.0, 1.0)],
                               "total_incurred double, total_paid double, total_os double")
    c = rc.Cols(df)
    assert run(df, rc.sum_within_tolerance(c, "total_incurred", "total_paid", "total_os", 0))[:3] == (2, 1, 1)
    assert run(df, rc.sum_within_tolerance(c, "total_incurred", "total_paid", "total_os", 5))[:3] == (2, 2, 0)
    empty = df.where("false")
    assert run(empty, rc.sum_within_tolerance(rc.Cols(empty), "total_incurred", "total_paid", "total_os", 5))[3] == 0.0


def test_absent_column_is_reported(spark):
    df = strings(spark)
    chk = rc.not_null(rc.Cols(df), "claim_number")
    assert chk.missing == "claim_number"


def test_expression_check(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    assert run(df, rc.expression(rc.Cols(df), "a >= b"))[:3] == (3, 1, 2)
