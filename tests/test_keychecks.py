"""Key, set and snapshot checks on hand tables."""
from veracity.operators import keychecks as kc


def counts(df):
    r = df.collect()[0]
    assert r.passed + r.failed == r.total
    return r.total, r.passed, r.failed


def keys(spark, vals):
    return spark.createDataFrame([(v,) for v in vals], "claim_number string")


def test_unique_nulls_equal(spark):
    df = keys(spark, ["a", "b", "b", None, None])
    assert counts(kc.uniqueness(df, "claim_number", "none")) == (5, 1, 4)
    assert counts(kc.uniqueness(df, "claim_number", "first")) == (5, 3, 2)
    one_null = keys(spark, ["a", "b", "b", None])
    assert counts(kc.uniqueness(one_null, "claim_number", "none")) == (4, 2, 2)
    assert sorted(r.claim_number or "" for r in kc.failing_duplicates(df, "claim_number").collect()) == \
        ["", "", "b", "b"]


def snapshots(spark):
    schema = "claim_number string, total_paid double"
    cur = spark.createDataFrame([("k1", 10.0), ("k3", 1.0), ("k4", None), ("k5", 3.0), ("k6", 2.0),
                                 ("k7", 1.0), ("k7", 2.0), (None, 5.0)], schema)
    prev = spark.createDataFrame([("k1", 5.0), ("k2", 1.0), ("k4", 1.0), ("k5", 4.0), ("k6", 2.0),
                                  ("k7", 3.0), (None, 4.0), (None, 6.0)], schema)
    return cur, prev


def test_missing_keys(spark):
    cur, prev = snapshots(spark)
    assert counts(kc.missing_keys(cur, prev, "claim_number")) == (6, 5, 1)
    assert [r.claim_number for r in kc.failing_missing_keys(cur, prev, "claim_number").collect()] == ["k2"]


def test_paid_not_decreasing_left(spark):
    cur, prev = snapshots(spark)
    assert counts(kc.paid_not_decreasing(cur, prev, "claim_number", "total_paid")) == (6, 4, 2)
    bad = sorted(r.claim_number for r in kc.failing_paid_keys(cur, prev, "claim_number", "total_paid").collect())
    assert bad == ["k4", "k5"]


def test_paid_not_decreasing_rows_counts_pairs(spark):
    cur, prev = snapshots(spark)
    # pairs: k1 ok, k4 null, k5 lower, k6 equal ok, k7 1<3 and 2<3, null key 5>=4 ok and 5<6
    assert counts(kc.paid_not_decreasing_rows(cur, prev, "claim_number", "total_paid")) == (8, 3, 5)


def test_key_profile_matches_separate_checks(spark):
    cur, prev = snapshots(spark)
    p = kc.key_profile(cur, prev, "claim_number", "total_paid").collect()[0]
    assert (p.u_total, p.u_total - p.u_failed) == counts(kc.uniqueness(cur, "claim_number"))[:2]
    assert (p.m_total, p.m_passed) == counts(kc.missing_keys(cur, prev, "claim_number"))[:2]
    assert (p.p_total, p.p_passed) == counts(kc.paid_not_decreasing(cur, prev, "claim_number", "total_paid"))[:2]


def test_reference_keys_and_fallback(spark):
    claims = spark.createDataFrame([("P1",), ("P2",), ("P2",), ("  ",), (None,)], "policy_number string")
    risk = spark.createDataFrame([("P1",), ("P1",)], "PolicyNumber string")
    assert kc.resolve_risk_key(risk, "risk_policy_number") == "PolicyNumber"
    assert counts(kc.keys_in_reference(claims, risk, "policy_number", "PolicyNumber")) == (3, 1, 2)
    assert kc.resolve_risk_key(spark.createDataFrame([("x",)], "other string"), "risk_policy_number") is None


def test_loss_ratio_division_by_zero_fails(spark):
    claims = spark.createDataFrame([("P1", 10.0), ("P1", 5.0), ("P2", 1.0), ("P3", None), (None, 9.0)],
                                   "policy_number string, gross_incurred double")
    risk = spark.createDataFrame([("P1", 20.0), ("P2", 0.0), ("P3", 1.0), ("P4", 1.0)],
                                 "risk_policy_number string, gwp double")
    # P1 15/20 ok, P2 /0 fails, P3 all-null sum reads 0 -> ratio 0 ok
    assert counts(kc.loss_ratio(claims, risk)) == (3, 2, 1)


def test_paid_rows_hot_key_is_exact(spark):
    """One key holding most rows, many distinct values: bucketed counting equals brute force."""
    import random
    rnd = random.Random(7)
    cur_rows = [("hot", float(rnd.randint(0, 500))) for _ in range(3000)] + \
               [(f"k{i}", float(rnd.randint(0, 9))) for i in range(200)] + [(None, 3.0), ("hot", None)]
    prev_rows = [("hot", float(rnd.randint(0, 500))) for _ in range(2000)] + \
                [(f"k{i}", float(rnd.randint(0, 9))) for i in range(0, 200, 2)] + [(None, 2.0), (None, 4.0)]
    schema = "claim_number string, total_paid double"
    cur, prev = spark.createDataFrame(cur_rows, schema), spark.createDataFrame(prev_rows, schema)
    total = passed = 0
    from collections import defaultdict
    by_key = defaultdict(list)
    for k, v in prev_rows:
        by_key[k].append(v)
    for k, v in cur_rows:
        for pv in by_key.get(k, []):
            total += 1
            passed += int(v is not None and pv is not None and v >= pv)
    for b in (1, 4, 128):
        assert counts(kc.paid_not_decreasing_rows(cur, prev, "claim_number", "total_paid", buckets=b)) == \
            (total, passed, total - passed)
