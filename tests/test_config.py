"""Suites from configuration dictionaries."""
from veracity.catalog import ROOT_DECLARED_CONFIG
from veracity.plans.config import specs_from_config
from veracity.plans.spec import POLICIES, CheckSpec
from veracity.plans.suite import run_suite


def test_declared_translation():
    specs = {s.id: s for s in specs_from_config(ROOT_DECLARED_CONFIG, 2002)}
    assert specs["2.1"].type == "expression"
    assert specs["2.1"].predicate == "abs((gross_incurred) - (gross_paid + gross_estimate)) <= 1.0"
    assert specs["2.1"].fields == ("gross_incurred", "gross_paid", "gross_estimate")
    assert specs["3.2"].bounds == (1987.0, 2002.0)
    assert specs["4.1"].type == "unique" and specs["5.6"].type == "year_matches_date"
    assert specs["2.3"].thresholds == ((99.0, 3.0), (97.0, 2.0), (95.0, 1.0))


def test_flat_config_and_absent_columns(spark):
    cfg = {"checks": [
        {"id": "1", "name": "a", "type": "not_null", "field": "x", "category": "C", "subcategory": "S", "points": 5},
        {"id": "2", "name": "b", "type": "not_null", "field": "gone", "category": "C", "subcategory": "S",
         "points": 5, "enabled": True},
        {"id": "3", "name": "c", "type": "unique", "field": "x", "category": "C", "subcategory": "S", "points": 5,
         "enabled": False}]}
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    rows = {r.check_id: r for r in run_suite(specs_from_config(cfg, 2002), POLICIES["v5"], df).checks.collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"].total, rows["1"].passed) == (3, 2)
    assert rows["2"].error == "column not found: gone" and rows["2"].points_earned == 0


def test_declared_expression_with_absent_column(spark):
    spec = CheckSpec("9", "f", "expression", "C", "S", 3, predicate="a <= b", fields=("a", "b"))
    df = spark.createDataFrame([(1.0,)], "a double")
    r = run_suite([spec], POLICIES["root"], df).checks.collect()[0]
    assert r.error == "column not found: b"


def test_reference_key_not_found(spark):
    claims = spark.createDataFrame([("P1",), ("P2",)], "policy_number string")
    risk = spark.createDataFrame([("P1",)], "something_else string")
    spec = CheckSpec("8.1", "risk", "risk_policy_match", "Risk", "Cross Table", 10)
    r = run_suite([spec], POLICIES["v5"], claims, risk=risk).checks.collect()[0]
    assert (r.total, r.passed, r.failed, r.pass_rate, r.points_earned) == (2, 0, 2, 0.0, 0.0)
