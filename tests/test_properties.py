"""Random tables against a brute-force reading of the rules (few examples: each runs Spark jobs)."""
import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veracity.catalog import check_frame
from veracity.operators import keychecks as kc
from veracity.operators import rowchecks as rc

STATUS = st.sampled_from(["Closed", " closed ", "RE-CLOSED", "Disclosed", "Open", "CLOSED-X", "", None])
OS = st.sampled_from([0.0, 1.0, -2.0, None])
KEYS = st.sampled_from(["a", "b", "c", None])
PAID = st.sampled_from([1.0, 2.0, 3.0, None])
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def closed_brute(status, match):
    if status is None:
        return False
    if match == "word":
        return re.search(r"\bCLOSED\b", status.strip().upper()) is not None
    if match == "substring":
        return "closed" in status.strip().lower()
    if match == "exact":
        return status.strip().lower() == "closed"
    return status == "Closed"


@SETTINGS
@given(rows=st.lists(st.tuples(STATUS, OS), min_size=0, max_size=30))
def test_closed_matchers(spark, rows):
    df = spark.createDataFrame(rows, "claim_status string, total_os double")
    for match, os_null in (("word", "fail"), ("substring", "pass"), ("exact", "pass"), ("case_sensitive", "fail")):
        scope = [(s, o) for s, o in rows if closed_brute(s, match)]
        passed = sum(1 for _, o in scope if (o == 0.0) or (o is None and os_null == "pass"))
        r = check_frame(df, rc.closed_os_zero(rc.Cols(df), "claim_status", "total_os", ["Closed"], match,
                                              os_null)).collect()[0]
        assert (r.total, r.passed) == (len(scope), passed), match
        assert r.pass_rate == (passed / len(scope) * 100.0 if scope else 100.0)


@SETTINGS
@given(cur=st.lists(st.tuples(KEYS, PAID), max_size=25), prev=st.lists(st.tuples(KEYS, PAID), max_size=25))
def test_key_profile_against_brute_force(spark, cur, prev):
    schema = "claim_number string, total_paid double"
    cdf, pdf = spark.createDataFrame(cur, schema), spark.createDataFrame(prev, schema)
    counts = Counter(k for k, _ in cur)
    dup_rows = sum(n for n in counts.values() if n > 1)
    prev_keys = {k for k, _ in prev if k is not None}
    cur_keys = {k for k, _ in cur if k is not None}

    def sums(rows):
        out = defaultdict(list)
        for k, v in rows:
            if k is not None:
                out[k].append(v)
        return {k: (None if all(x is None for x in vs) else sum(x for x in vs if x is not None))
                for k, vs in out.items()}

    cs, ps = sums(cur), sums(prev)
    paid_ok = sum(1 for k, v in cs.items() if v is not None and v >= (ps.get(k) if ps.get(k) is not None
                                                                       else float("-inf")))
    p = kc.key_profile(cdf, pdf, "claim_number", "total_paid").collect()[0]
    assert (p.u_total or 0, p.u_failed or 0, p.u_groups or 0) == (len(cur), dup_rows, len(counts))
    assert (p.m_total, p.m_passed) == (len(prev_keys), len(prev_keys & cur_keys))
    assert (p.p_total, p.p_passed) == (len(cs), paid_ok)
    pairs = [(cv, pv) for ck, cv in cur for pk, pv in prev if ck == pk]
    ok = sum(1 for cv, pv in pairs if cv is not None and pv is not None and cv >= pv)
    r = kc.paid_not_decreasing_rows(cdf, pdf, "claim_number", "total_paid", buckets=3).collect()[0]
    assert (r.total, r.passed) == (len(pairs), ok)
