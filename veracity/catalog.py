"""Registered queries: each pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with its
DuckDB oracle SQL (or ``None`` where only a row-count check applies).

Every query reads the given tables (through the claims-shaped views in
``veracity.sources.fixtures``), whole, so its work grows with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity import oracle as O
from veracity.functions import coerce as C
from veracity.functions import text as TX
from veracity.operators import keychecks as kc
from veracity.operators import mapping as mp
from veracity.operators import premium as pm
from veracity.operators import rowchecks as rc
from veracity.plans import reports as rp
from veracity.plans import scoring as sc
from veracity.plans.spec import POLICIES, default_suite, suite_root, suite_v2
from veracity.plans.suite import SuiteRun, run_suite
from veracity.sources import fixtures as fx
from veracity.sources import snapshots as sn

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

# The evaluation year of the accident-year range check in the registered queries.
AS_OF_YEAR = 2002
RUN_TS = "2024-01-01 00:00:00"


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def ts_text(df: DataFrame) -> DataFrame:
    """Timestamps as 'yyyy-MM-dd HH:mm:ss' text (engine-neutral result columns)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def check_frame(df: DataFrame, chk: rc.RowCheck) -> DataFrame:
    """Counts and pass rate of one row check."""
    agg = df.agg(F.count_if(chk.scope).alias("total"),
                 F.count_if(chk.scope & F.coalesce(chk.ok, F.lit(False))).alias("passed"))
    return agg.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"),
                      sc.pass_rate(F.col("total"), F.col("passed"), F.lit(float(chk.empty_rate))).alias("pass_rate"))


def _cur(spark, sf):
    return fx.claims_snapshot(spark, sf, True)


def _prev(spark, sf):
    return fx.claims_snapshot(spark, sf, False)


CLAIM_COLS = ["policy_number", "claim_number", "accident_date", "claim_status", "uw_date", "policy_start_date",
              "policy_end_date", "total_incurred", "total_paid", "total_os"]
CLAIM_SQL_COLS = ", ".join(O.ts_text(c) + f" as {c}" if c.endswith("date") else c for c in CLAIM_COLS)

# ---- S: snapshots ---------------------------------------------------------------------------------------


@register("snap_list", O.with_fixtures(
    "select distinct " + O.ts_text("bdx_month") + " as bdx_month from claims_hist where bdx_month is not null",
    "claims_hist"))
def q_snap_list(spark, sf):
    return ts_text(sn.list_snapshots(fx.claims_history(spark, sf), "bdx_month"))


@register("snap_load", O.with_fixtures(
    f"select {CLAIM_SQL_COLS} from claims_hist where bdx_month = timestamp '{fx.CURRENT_BDX}'", "claims_hist"))
def q_snap_load(spark, sf):
    hist = fx.claims_history(spark, sf)
    return ts_text(sn.load_snapshot(hist, fx.CURRENT_BDX).select(*CLAIM_COLS))


@register("snap_range", O.with_fixtures(
    f"select {O.ts_text('bdx_month')} as bdx_month, count(*) as record_count from claims_hist "
    f"where bdx_month >= timestamp '{fx.PREVIOUS_BDX}' and bdx_month <= timestamp '{fx.CURRENT_BDX}' group by 1",
    "claims_hist"))
def q_snap_range(spark, sf):
    hist = sn.load_range(fx.claims_history(spark, sf), fx.PREVIOUS_BDX, fx.CURRENT_BDX)
    return ts_text(sn.counts_by_snapshot(hist, "bdx_month"))


@register("snap_counts", O.with_fixtures(
    f"select count(*) as record_count from claims_hist where bdx_month = timestamp '{fx.CURRENT_BDX}'",
    "claims_hist"))
def q_snap_counts(spark, sf):
    return sn.count_rows(sn.load_snapshot(fx.claims_history(spark, sf), fx.CURRENT_BDX))


@register("snap_previous", O.with_fixtures(
    f"select {O.ts_text('bdx_month')} as bdx_month, {O.ts_text('previous_snapshot')} as previous_snapshot from "
    f"(select bdx_month, lag(bdx_month) over (order by bdx_month) as previous_snapshot from "
    f"(select distinct bdx_month from claims_hist where bdx_month is not null))", "claims_hist"))
def q_snap_previous(spark, sf):
    return ts_text(sn.previous_snapshots(fx.claims_history(spark, sf), "bdx_month"))


@register("snap_previous_of", O.with_fixtures(
    f"select {O.ts_text('p')} as previous_snapshot from (select case when count(*) filter "
    f"(where bdx_month = timestamp '{fx.CURRENT_BDX}') > 0 then max(bdx_month) filter "
    f"(where bdx_month < timestamp '{fx.CURRENT_BDX}') end as p from claims_hist "
    f"where bdx_month <= timestamp '{fx.CURRENT_BDX}')", "claims_hist"))
def q_snap_previous_of(spark, sf):
    return ts_text(sn.previous_snapshot(fx.claims_history(spark, sf), fx.CURRENT_BDX, "bdx_month"))


_PREVIEW_ORDER = ["claim_number", "policy_number", "total_paid", "total_incurred", "total_os", "accident_date",
                  "uw_date", "claim_status", "policy_start_date", "policy_end_date"]


@register("snap_preview", O.with_fixtures(
    f"select {CLAIM_SQL_COLS} from claims_cur order by "
    + ", ".join(f"{c} asc nulls first" for c in _PREVIEW_ORDER) + " limit 5", "claims_cur"))
def q_snap_preview(spark, sf):
    return ts_text(sn.preview(_cur(spark, sf), 5, [F.col(c).asc_nulls_first() for c in _PREVIEW_ORDER])
                   .select(*CLAIM_COLS))


# ---- P: mapping and coercion ------------------------------------------------------------------------------

# A physical layout whose names the alias table resolves; uw_date and policy_start_date
# both resolve to 'Policy Start Date'.
PHYSICAL_NAMES = {"policy_number": "Policy Number", "claim_number": "Claim_Number", "accident_date": "Date of Loss",
                  "claim_status": "Status", "policy_start_date": "Policy Start Date",
                  "policy_end_date": "Expiry Date", "total_incurred": "Incurred", "total_paid": "Paid Amount",
                  "total_os": "Total Outstanding"}


@register("map_shared_column", O.with_fixtures(
    "select count(*) as n, count(policy_start_date) as uw_date_present, count(policy_start_date) as start_present, "
    "count(*) filter (where policy_start_date = policy_start_date) as same_value, "
    "count(*) filter (where policy_number is not null) as policy_present from claims_cur", "claims_cur"))
def q_map_shared_column(spark, sf):
    phys = _cur(spark, sf).drop("uw_date")
    phys = phys.select(*[F.col(c).alias(PHYSICAL_NAMES.get(c, c)) for c in phys.columns])
    mapping = mp.auto_match(phys.columns)
    df = mp.apply_mapping(phys, mapping)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("uw_date").alias("uw_date_present"),
                  F.count("policy_start_date").alias("start_present"),
                  F.count_if(F.col("uw_date") == F.col("policy_start_date")).alias("same_value"),
                  F.count("policy_number").alias("policy_present"))


@register("coerce_types", O.with_fixtures(
    f"select count(*) as n, count({O.parse_ts('accident_date_raw')}) as parsed, "
    f"count(*) filter (where accident_date_raw is null) as raw_null, "
    f"count(*) filter (where accident_date_raw is not null and {O.parse_ts('accident_date_raw')} is null) "
    f"as unparsable from raw_dates", "raw_dates"))
def q_coerce_types(spark, sf):
    raw = fx.raw_dates(spark, sf)
    d = C.as_timestamp(F.col("accident_date_raw"), T.StringType())
    return raw.agg(F.count(F.lit(1)).alias("n"), F.count(d).alias("parsed"),
                   F.count_if(F.col("accident_date_raw").isNull()).alias("raw_null"),
                   F.count_if(F.col("accident_date_raw").isNotNull() & d.isNull()).alias("unparsable"))


@register("coerce_numeric", O.with_fixtures(
    "select count(*) as n, count(try_cast(building_prem as double)) as parsed, "
    "round(sum(try_cast(building_prem as double)), 6) as total from premium_input", "premium_input"))
def q_coerce_numeric(spark, sf):
    p = fx.premium_input(spark, sf)
    x = C.as_double(F.col("building_prem"), T.StringType())
    return p.agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("parsed"), F.round(F.sum(x), 6).alias("total"))


@register("quarter_label", O.with_fixtures(
    "select cast(year(accident_date) as varchar) || '_Q' || cast(quarter(accident_date) as varchar) as quarter_id, "
    "count(*) as n from claims_cur group by 1", "claims_cur"))
def q_quarter_label(spark, sf):
    return _cur(spark, sf).groupBy(TX.quarter_label(F.col("accident_date")).alias("quarter_id")) \
        .agg(F.count(F.lit(1)).alias("n"))


# ---- K: row checks ---------------------------------------------------------------------------------------

def _row_query(name: str, fixture: str, scope: str, ok: str, empty: float, build):
    REGISTRY[name] = (build, O.with_fixtures(O.check_sql(fixture, scope, ok, empty), fixture))


def _k(df_fn, make):
    def q(spark, sf):
        df = df_fn(spark, sf)
        return check_frame(df, make(rc.Cols(df)))
    return q


def _root(spark, sf):
    return fx.claims_root(spark, sf)


def _raw(spark, sf):
    return fx.raw_dates(spark, sf)


_PT = O.parse_ts("accident_date_raw")
_ROW_QUERIES = [
    ("k_not_null", "claims_cur", "true", "policy_number is not null and trim(policy_number) <> ''", 0.0,
     _cur, lambda c: rc.not_null(c, "policy_number", True)),
    ("k_not_null_null_only", "claims_cur", "true", "policy_number is not null", 0.0,
     _cur, lambda c: rc.not_null(c, "policy_number", False)),
    ("k_not_null_date", "claims_cur", "true", "accident_date is not null", 0.0,
     _cur, lambda c: rc.not_null(c, "accident_date", True)),
    ("k_uw_date", "claims_cur", "true", "uw_date is not null and year(uw_date) <> 1900", 0.0,
     _cur, lambda c: rc.not_null_not_year_1900(c, "uw_date")),
    ("k_non_negative_strict", "claims_cur", "true", "total_os >= 0", 0.0,
     _cur, lambda c: rc.non_negative(c, "total_os", "fail")),
    ("k_non_negative_lenient", "claims_cur", "true", "total_os is null or total_os >= 0", 0.0,
     _cur, lambda c: rc.non_negative(c, "total_os", "pass")),
    ("k_non_negative_dropnull", "claims_cur", "total_os is not null", "total_os >= 0", 100.0,
     _cur, lambda c: rc.non_negative(c, "total_os", "drop")),
    ("k_non_negative_multi", "claims_root", "true",
     " and ".join(f"({x} is null or {x} >= 0)" for x in ("gross_paid", "gross_incurred", "net_paid", "net_incurred")),
     0.0, _root, lambda c: rc.non_negative_all(c, ("gross_paid", "gross_incurred", "net_paid", "net_incurred"))),
    ("k_valid_date_strict", "raw_dates", "true", f"{_PT} is not null", 0.0,
     _raw, lambda c: rc.valid_date(c, "accident_date_raw", "fail")),
    ("k_valid_date_lenient", "raw_dates", "true", f"{_PT} is not null or accident_date_raw is null", 0.0,
     _raw, lambda c: rc.valid_date(c, "accident_date_raw", "pass")),
    ("k_valid_dates_multi", "raw_dates", "true",
     f"({_PT} is not null or accident_date_raw is null) and "
     f"({O.parse_ts('notification_raw')} is not null or notification_raw is null)", 0.0,
     _raw, lambda c: rc.valid_dates_all(c, ("accident_date_raw", "notification_raw"))),
    ("k_closed_empty_scope", "claims_cur", "claim_status = 'Nothing'", "total_os = 0", 100.0,
     _cur, lambda c: rc.closed_os_zero(c, "claim_status", "total_os", ["Nothing"], "case_sensitive", "fail")),
    ("k_expr_divisor", "claims_cur", "total_paid is not null", "total_incurred / nullif(total_os, 0) >= 2", 0.0,
     _cur, lambda c: rc.expression(c, "total_incurred / total_os >= 2", "total_paid is not null")),
    ("k_year_range", "claims_root", "true", f"accident_year between {AS_OF_YEAR - 15} and {AS_OF_YEAR}", 0.0,
     _root, lambda c: rc.year_in_range(c, "accident_year", AS_OF_YEAR)),
    ("k_closed_word", "claims_cur", O.closed_sql(O.POLICIES["v5"]), "total_os = 0", 100.0,
     _cur, lambda c: rc.closed_os_zero(c, "claim_status", "total_os", ["Closed"], "word", "fail")),
    ("k_closed_substring", "claims_cur", O.closed_sql(O.POLICIES["v4"]), "coalesce(total_os, 0) = 0", 100.0,
     _cur, lambda c: rc.closed_os_zero(c, "claim_status", "total_os", ["Closed"], "substring", "pass")),
    ("k_closed_exact", "claims_cur", O.closed_sql(O.POLICIES["v1"]), "coalesce(total_os, 0) = 0", 100.0,
     _cur, lambda c: rc.closed_os_zero(c, "claim_status", "total_os", ["Closed"], "exact", "pass")),
    ("k_closed_case_sensitive", "claims_cur", O.closed_sql(O.POLICIES["v2"], (" Closed ", "RE-CLOSED")),
     "total_os = 0", 100.0,
     _cur, lambda c: rc.closed_os_zero(c, "claim_status", "total_os", [" Closed ", "RE-CLOSED"],
                                       "case_sensitive", "fail")),
    ("k_loss_v5", "claims_cur", "accident_date is not null",
     "accident_date >= policy_start_date and accident_date <= policy_end_date", 0.0,
     _cur, lambda c: rc.loss_within_policy(c, rule="v5")),
    ("k_loss_row_fallback", "claims_cur",
     "accident_date is not null and policy_start_date is not null and "
     "coalesce(policy_end_date, policy_start_date + interval '1' year) is not null",
     "accident_date >= policy_start_date and accident_date <= "
     "coalesce(policy_end_date, policy_start_date + interval '1' year)", 0.0,
     _cur, lambda c: rc.loss_within_policy(c, rule="row_fallback")),
    ("k_loss_no_fallback", "claims_cur",
     "accident_date is not null and policy_start_date is not null and policy_end_date is not null",
     "accident_date >= policy_start_date and accident_date <= policy_end_date", 0.0,
     _cur, lambda c: rc.loss_within_policy(c, rule="no_fallback")),
    ("k_loss_missing_end", "claims_cur", "accident_date is not null",
     "accident_date >= policy_start_date and accident_date <= policy_start_date + interval '1' year", 0.0,
     lambda s, f: _cur(s, f).drop("policy_end_date"), lambda c: rc.loss_within_policy(c, rule="v5")),
    ("k_formula_tol", "claims_cur", "total_incurred is not null and total_paid is not null and total_os is not null",
     "abs(total_incurred - (total_paid + total_os)) <= 5.0", 0.0,
     _cur, lambda c: rc.sum_within_tolerance(c, "total_incurred", "total_paid", "total_os", 5)),
    ("k_gross_formula", "claims_root",
     "gross_incurred is not null and gross_paid is not null and gross_estimate is not null",
     "abs(gross_incurred - (gross_paid + gross_estimate)) <= 1.0", 0.0,
     _root, lambda c: rc.sum_within_tolerance(c, "gross_incurred", "gross_paid", "gross_estimate", 1)),
    ("k_net_gross", "claims_root",
     "net_paid is not null and gross_paid is not null and net_incurred is not null and gross_incurred is not null",
     "net_paid <= gross_paid and net_incurred <= gross_incurred", 0.0, _root, lambda c: rc.net_within_gross(c)),
    ("k_date_sequence", "claims_root", "accident_date is not null and notification_date is not null",
     "accident_date <= notification_date", 0.0,
     _root, lambda c: rc.date_not_after(c, "accident_date", "notification_date")),
    ("k_year_matches", "claims_root", "accident_year is not null and accident_date is not null",
     "accident_year = year(accident_date)", 0.0,
     _root, lambda c: rc.year_matches_date(c, "accident_year", "accident_date")),
    ("k_expr", "claims_cur", "total_paid is not null", "total_incurred >= total_paid", 0.0,
     _cur, lambda c: rc.expression(c, "total_incurred >= total_paid", "total_paid is not null")),
]
for _name, _fix, _scope, _ok, _empty, _dfn, _mk in _ROW_QUERIES:
    _row_query(_name, _fix, _scope, _ok, _empty, _k(_dfn, _mk))


# ---- J: key, set and snapshot checks ----------------------------------------------------------------------

def _counts_sql(body: str) -> str:
    return f"select total::bigint as total, passed::bigint as passed, failed::bigint as failed from ({body})"


def _spec(t, field=None):
    from veracity.plans.spec import CheckSpec
    return CheckSpec("x", "x", t, "c", "s", 1, field=field)


@register("j_unique_all", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("unique", "claim_number"), O.POLICIES["v5"], "claims_cur", None, None)[0]), "claims_cur"))
def q_j_unique_all(spark, sf):
    return kc.uniqueness(_cur(spark, sf), "claim_number", "none")


@register("j_unique_first", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("unique", "claim_number"), O.POLICIES["v2"], "claims_cur", None, None)[0]), "claims_cur"))
def q_j_unique_first(spark, sf):
    return kc.uniqueness(_cur(spark, sf), "claim_number", "first")


@register("j_missing_claims", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("missing_claims_from_prev_month"), O.POLICIES["v5"], "claims_cur", "claims_prev", None)[0]),
    "claims_cur", "claims_prev"))
def q_j_missing_claims(spark, sf):
    return kc.missing_keys(_cur(spark, sf), _prev(spark, sf), "claim_number")


@register("j_paid_left", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("total_paid_non_decreasing_vs_prev"), O.POLICIES["v5"], "claims_cur", "claims_prev", None)[0]),
    "claims_cur", "claims_prev"))
def q_j_paid_left(spark, sf):
    return kc.paid_not_decreasing(_cur(spark, sf), _prev(spark, sf), "claim_number", "total_paid")


@register("j_paid_inner", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("total_paid_non_decreasing_vs_prev"), O.POLICIES["v2"], "claims_cur", "claims_prev", None)[0]),
    "claims_cur", "claims_prev"))
def q_j_paid_inner(spark, sf):
    return kc.paid_not_decreasing_rows(_cur(spark, sf), _prev(spark, sf), "claim_number", "total_paid", parts=fx.claim_parts(spark, sf))


@register("j_risk_anti", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("risk_policy_match"), O.POLICIES["v5"], "claims_cur", None, "risk")[0]), "claims_cur", "risk"))
def q_j_risk_anti(spark, sf):
    return kc.keys_in_reference(_cur(spark, sf), fx.risk_table(spark, sf), "policy_number", "risk_policy_number")


@register("j_risk_semi", O.with_fixtures(
    "select distinct policy_number from claims_cur where policy_number is not null and policy_number in "
    "(select risk_policy_number from risk)", "claims_cur", "risk"))
def q_j_risk_semi(spark, sf):
    return kc.matched_reference_keys(_cur(spark, sf), fx.risk_table(spark, sf), "policy_number", "risk_policy_number")


@register("j_risk_missing_keys", O.with_fixtures(
    "select distinct policy_number from claims_cur where policy_number is not null and policy_number not in "
    "(select risk_policy_number from risk where risk_policy_number is not null)", "claims_cur", "risk"))
def q_j_risk_missing_keys(spark, sf):
    return kc.failing_reference_keys(_cur(spark, sf), fx.risk_table(spark, sf), "policy_number",
                                     "risk_policy_number")


@register("j_loss_ratio", O.with_fixtures(_counts_sql(O.key_check_sql(
    _spec("loss_ratio"), O.POLICIES["root"], "claims_root", None, "risk")[0]), "claims_root", "risk"))
def q_j_loss_ratio(spark, sf):
    return kc.loss_ratio(fx.claims_root(spark, sf), fx.risk_table(spark, sf))


@register("j_loss_ratio_rows", O.with_fixtures(
    "select a.k as policy_number, round(a.v, 6) as total_incurred, r.gwp, "
    "coalesce(a.v / nullif(r.gwp, 0) between 0 and 1.5, false) as ok from "
    "(select policy_number as k, coalesce(sum(gross_incurred), 0) as v from claims_root "
    "where policy_number is not null group by 1) a join risk r on a.k = r.risk_policy_number",
    "claims_root", "risk"))
def q_j_loss_ratio_rows(spark, sf):
    t = kc.loss_ratio_table(fx.claims_root(spark, sf), fx.risk_table(spark, sf))
    return t.select("policy_number", F.round("total_incurred", 6).alias("total_incurred"), "gwp", "ok")


@register("j_missing_keys", O.with_fixtures(
    "select distinct claim_number from claims_prev where claim_number is not null except "
    "select distinct claim_number from claims_cur", "claims_cur", "claims_prev"))
def q_j_missing_keys(spark, sf):
    return kc.failing_missing_keys(_cur(spark, sf), _prev(spark, sf), "claim_number")


@register("j_paid_failing_keys", O.with_fixtures(
    "select c.k as claim_number from (select claim_number as k, sum(total_paid) as v from claims_cur "
    "where claim_number is not null group by 1) c left join (select claim_number as k, sum(total_paid) as v "
    "from claims_prev where claim_number is not null group by 1) p on c.k = p.k "
    "where not coalesce(c.v >= coalesce(p.v, '-inf'::double), false)", "claims_cur", "claims_prev"))
def q_j_paid_failing_keys(spark, sf):
    return kc.failing_paid_keys(_cur(spark, sf), _prev(spark, sf), "claim_number", "total_paid") \
        .select("claim_number")


# ---- suites (A*, J9, J10, S9-S13) ---------------------------------------------------------------------------

def v5_run(spark, sf, include_risk=True, with_prev=True, policy="v5") -> SuiteRun:
    cur = _cur(spark, sf)
    prev = _prev(spark, sf) if with_prev else None
    risk = fx.risk_table(spark, sf) if include_risk else None
    return run_suite(default_suite(include_risk=True), POLICIES[policy], cur, prev, risk, ["Closed"], AS_OF_YEAR,
                     key_parts=fx.claim_parts(spark, sf))


def v2_run(spark, sf) -> SuiteRun:
    return run_suite(suite_v2(), POLICIES["v2"], _cur(spark, sf), _prev(spark, sf), fx.risk_table(spark, sf),
                     [" Closed ", "RE-CLOSED"], AS_OF_YEAR, key_parts=fx.claim_parts(spark, sf))


def root_run(spark, sf) -> SuiteRun:
    return run_suite(suite_root(AS_OF_YEAR), POLICIES["root"], fx.claims_root(spark, sf), None,
                     fx.risk_table(spark, sf), as_of_year=AS_OF_YEAR, key_parts=fx.claim_parts(spark, sf))


SUITE_COLS = ["check_id", "check_type", "category", "points_possible", "total", "passed", "failed", "pass_rate",
              "points_earned", "skipped", "status"]


def _suite_sql(policy_name: str, prev=True, risk=True, closed=None) -> str:
    from dataclasses import replace
    pol = O.POLICIES[policy_name]
    if closed:
        pol = replace(pol, closed_values=tuple(closed))
    if policy_name == "v2":
        specs = suite_v2()
    elif policy_name == "root":
        specs = suite_root(AS_OF_YEAR)
    else:
        specs = default_suite(include_risk=True)
    cur = "claims_root" if policy_name == "root" else "claims_cur"
    body = O.suite_sql(specs, pol, cur, "claims_prev" if prev else None, "risk" if risk else None, AS_OF_YEAR)
    fixtures = [cur] + (["claims_prev"] if prev else []) + (["risk"] if risk else [])
    return body, fixtures


def _suite_query(name: str, policy_name: str, run_fn, prev=True, risk=True, closed=None):
    body, fixtures = _suite_sql(policy_name, prev, risk, closed)
    sql = O.with_fixtures(f"select {', '.join(SUITE_COLS)} from ({body})", *fixtures)
    REGISTRY[name] = (lambda spark, sf: run_fn(spark, sf).checks.select(*SUITE_COLS), sql)


_suite_query("suite_v5", "v5", v5_run)
_suite_query("suite_v4", "v4", lambda s, f: v5_run(s, f, policy="v4"))
_suite_query("suite_v0", "v0", lambda s, f: v5_run(s, f, policy="v0"))
_suite_query("suite_v3", "v3", lambda s, f: v5_run(s, f, policy="v3"))
_suite_query("suite_v1", "v1", lambda s, f: v5_run(s, f, policy="v1"))
_suite_query("suite_v2", "v2", v2_run, closed=[" Closed ", "RE-CLOSED"])
_suite_query("suite_root", "root", root_run, prev=False)
_suite_query("skipped_checks", "v5", lambda s, f: v5_run(s, f, include_risk=False, with_prev=False),
             prev=False, risk=False)
_suite_query("skipped_checks_zero", "v4", lambda s, f: v5_run(s, f, include_risk=False, with_prev=False, policy="v4"),
             prev=False, risk=False)


def _results_cte(policy_name: str, prev=True, risk=True, closed=None) -> tuple[str, list[str]]:
    body, fixtures = _suite_sql(policy_name, prev, risk, closed)
    return body, fixtures


def _over_results(name: str, policy_name: str, run_fn, spark_fn, sql_fn, prev=True, risk=True, closed=None):
    body, fixtures = _results_cte(policy_name, prev, risk, closed)
    sql = O.with_fixtures(sql_fn(f"({body})"), *fixtures)
    REGISTRY[name] = (lambda spark, sf: spark_fn(run_fn(spark, sf)), sql)


SCORE_COLS = ["overall_score", "total_checks", "passed_checks", "warning_checks", "failed_checks",
              "critical_issues_count", "risk_match_ok", "status"]

_over_results("overall_sum", "v5", v5_run, lambda r: r.score().select(*SCORE_COLS),
              lambda res: O.score_sql(res, O.POLICIES["v5"]))
_over_results("overall_percent", "v2", v2_run, lambda r: r.score().select(*SCORE_COLS),
              lambda res: O.score_sql(res, O.POLICIES["v2"]), closed=[" Closed ", "RE-CLOSED"])
_over_results("summary_counts_root", "root", root_run, lambda r: r.score().select(*SCORE_COLS),
              lambda res: O.score_sql(res, O.POLICIES["root"]), prev=False)
_over_results("status_bands", "v4", lambda s, f: v5_run(s, f, policy="v4"),
              lambda r: r.score().select("overall_score", "status"),
              lambda res: f"select overall_score, status from ({O.score_sql(res, O.POLICIES['v4'])})")
_over_results(
    "category_scores", "v5", v5_run, lambda r: r.categories(),
    lambda res: f"select category, sum(points_earned) as points_earned, sum(points_possible) as points_possible, "
                f"case when sum(points_possible) > 0 then sum(points_earned) / sum(points_possible) * 100.0 "
                f"else 0 end as percentage from {res} group by category")
_over_results(
    "category_scores_root", "root", root_run, lambda r: r.categories(),
    lambda res: f"select category, sum(points_earned) as points_earned, sum(points_possible) as points_possible, "
                f"case when sum(points_possible) > 0 then sum(points_earned) / sum(points_possible) * 100.0 "
                f"else 0 end as percentage from {res} group by category", prev=False)
_over_results(
    "critical_issues", "root", root_run, lambda r: sc.critical_issues(r.checks),
    lambda res: f"select check_id, check_name, failed as failed_count from {res} "
                f"where points_earned <> points_possible and not points_earned > 0 and priority = 'critical'",
    prev=False)


def _points_query(name: str, rule: str):
    """Apply one points rule to the canonical suite's pass rates."""
    from dataclasses import replace
    pol = replace(POLICIES["v5"], points_rule=rule)
    specs = default_suite(include_risk=True)
    if rule == "threshold":
        specs = [replace(s, thresholds=((98, s.points), (95, s.points / 2), (90, 1))) for s in specs]
    body = O.suite_sql(specs, replace(O.POLICIES["v5"], points_rule=rule), "claims_cur", "claims_prev", "risk", AS_OF_YEAR)
    sql = O.with_fixtures(f"select check_id, pass_rate, points_possible, points_earned from ({body})",
                          "claims_cur", "claims_prev", "risk")

    def q(spark, sf):
        run = run_suite(specs, pol, _cur(spark, sf), _prev(spark, sf), fx.risk_table(spark, sf), ["Closed"],
                        AS_OF_YEAR, key_parts=fx.claim_parts(spark, sf))
        return run.checks.select("check_id", "pass_rate", "points_possible", "points_earned")
    REGISTRY[name] = (q, sql)


for _rule in ("strict", "tiered", "linear", "all_or_nothing", "threshold"):
    _points_query(f"points_{_rule}", _rule)


# J9: failing rows with context columns
@register("failed_rows", O.with_fixtures(
    f"select claim_number, claim_status, total_os from claims_cur where {O.closed_sql(O.POLICIES['v5'])} "
    f"and not coalesce(total_os = 0, false)", "claims_cur"))
def q_failed_rows(spark, sf):
    return v5_run(spark, sf).failing("3.1")


@register("failed_rows_loss", O.with_fixtures(
    "select claim_number, " + ", ".join(f"{O.ts_text(c)} as {c}" for c in
                                        ("accident_date", "policy_start_date", "policy_end_date")) +
    " from claims_cur where accident_date is not null and not coalesce(accident_date >= policy_start_date "
    "and accident_date <= policy_end_date, false)", "claims_cur"))
def q_failed_rows_loss(spark, sf):
    return ts_text(v5_run(spark, sf).failing("3.2"))


@register("failed_rows_unique", O.with_fixtures(
    "select claim_number from claims_cur where claim_number in (select claim_number from claims_cur "
    "group by 1 having count(*) > 1) or (claim_number is null and (select count(*) from claims_cur "
    "where claim_number is null) > 1)", "claims_cur"))
def q_failed_rows_unique(spark, sf):
    return v5_run(spark, sf).failing("4.1")


# J10: first 100 failing identifiers
@register("failed_top100", O.with_fixtures(
    "select claim_number from (select distinct claim_number from claims_prev where claim_number is not null "
    "except select distinct claim_number from claims_cur) order by claim_number limit 100",
    "claims_cur", "claims_prev"))
def q_failed_top100(spark, sf):
    return v5_run(spark, sf).failing("6.1").orderBy("claim_number").limit(100)


# ---- S9-S13, F4, A17, A19 ---------------------------------------------------------------------------------

def _v5_cats_sql(res: str) -> str:
    from veracity.plans.spec import SCORE_CATEGORIES_V5
    parts = []
    for cat in SCORE_CATEGORIES_V5:
        k = cat.lower().replace("-", "_").replace(" ", "_")
        parts.append(f"cast(max(percentage) filter (where category = '{cat}') as decimal(5,2)) as {k}_score")
        parts.append(f"max(points_earned) filter (where category = '{cat}') as {k}_points")
    cats = (f"select category, sum(points_earned) as points_earned, case when sum(points_possible) > 0 then "
            f"sum(points_earned) / sum(points_possible) * 100.0 else 0 end as percentage from {res} group by 1")
    return f"select {', '.join(parts)} from ({cats})"


def _dq_scores_sql(res: str) -> str:
    score = O.score_sql(res, O.POLICIES["v5"])
    return (f"select '2024_Q1' as quarter_id, '{RUN_TS}' as run_timestamp, 'claims_db' as source_database, "
            f"'claims' as source_table, '1998-02' as bdx_month, "
            f"cast(s.overall_score as decimal(5,2)) as overall_score, s.status, "
            f"n.n as total_records, c.*, s.total_checks, s.passed_checks, s.warning_checks, s.failed_checks, "
            f"s.critical_issues_count from ({score}) s, ({_v5_cats_sql(res)}) c, "
            f"(select count(*) as n from claims_cur) n")


def _scores_of(run: SuiteRun, quarter: str = "2024_Q1", stamp: str = RUN_TS):
    return rp.dq_scores_row(run, quarter, stamp, run.total_records(), source_database="claims_db", source_table="claims",
                            bdx_month="1998-02")


def q_dq_scores(spark, sf):
    return ts_text(_scores_of(v5_run(spark, sf)))


_body, _fix = _suite_sql("v5")
REGISTRY["dq_scores_row"] = (q_dq_scores, O.with_fixtures(_dq_scores_sql(f"({_body})"), *_fix))


def _listed_sql(specs, policy) -> str:
    records = O.failing_records_sql(specs, policy, "claims_cur", "claims_prev", "risk")
    return (f"select check_id, cast(to_json(list(record order by record nulls first)[1:100]) as varchar) "
            f"as failed_records_json from ({records}) group by check_id")


_LISTED = _listed_sql(default_suite(include_risk=True), O.POLICIES["v5"])


def q_dq_check_results(spark, sf):
    return ts_text(rp.dq_check_results(v5_run(spark, sf), "2024_Q1", RUN_TS))


_RESULTS_SQL = (
    f"select '2024_Q1' as quarter_id, '{RUN_TS}' as run_timestamp, category, subcategory, check_id, check_name, priority, "
    f"cast(pass_rate as decimal(5,2)) as pass_rate, passed as passed_count, failed as failed_count, total as total_count, "
    f"points_possible, points_earned, status, coalesce(failed_records_json, '[]') as failed_records_json "
    f"from ({_body}) left join ({_LISTED}) using (check_id)")
REGISTRY["dq_check_results"] = (q_dq_check_results, O.with_fixtures(_RESULTS_SQL, *_fix))


def q_dq_issues(spark, sf):
    return ts_text(rp.dq_issues(rp.dq_check_results(v5_run(spark, sf), "2024_Q1", RUN_TS)))


REGISTRY["dq_issues"] = (q_dq_issues, O.with_fixtures(
    f"select quarter_id, run_timestamp, category, subcategory, check_id, check_name, priority, pass_rate, failed_count, "
    f"total_count, failed_records_json, false as resolved from ({_RESULTS_SQL}) where points_earned < points_possible", *_fix))
REGISTRY["failed_records_json"] = (
    lambda s, f: rp.failed_records_json(v5_run(s, f), ["6.1"]),
    O.with_fixtures(f"select * from ({_LISTED}) where check_id = '6.1'", *_fix))
REGISTRY["failed_records_all"] = (
    lambda s, f: rp.failed_records(v5_run(s, f), limit=None),
    O.with_fixtures(O.failing_records_sql(default_suite(include_risk=True), O.POLICIES["v5"], "claims_cur", "claims_prev",
                                          "risk"), *_fix))
REGISTRY["failed_records_v2"] = (
    lambda s, f: rp.failed_records(v2_run(s, f), limit=None),
    O.with_fixtures(O.failing_records_sql(
        suite_v2(), replace(O.POLICIES["v2"], closed_values=(" Closed ", "RE-CLOSED")), "claims_cur", "claims_prev", "risk"),
        *_fix))


def stored_scores(spark, sf):
    """Three runs appended to a fresh table at once and read back: January, February, and February run again
    without a reference table, later."""
    from veracity.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/veracity-scores-{uuid.uuid4().hex}"
    # each snapshot is stored by its first run, whose row checks the write counts, and read from there by the others
    stored = [f"{checkpoint_dir(spark).rstrip('/')}/veracity-snapshot-{uuid.uuid4().hex}" for _ in range(2)]
    parts = fx.claim_parts(spark, sf)
    jan = run_suite(default_suite(), POLICIES["v5"], _prev(spark, sf), None, None, ["Closed"], AS_OF_YEAR, store_to=stored[0],
                    key_parts=parts)
    feb = run_suite(default_suite(), POLICIES["v4"], _cur(spark, sf), jan.current, None, ["Closed"], AS_OF_YEAR, store_to=stored[1],
                    key_parts=parts)
    again = run_suite(default_suite(), POLICIES["v5"], feb.current, jan.current, None, ["Closed"], AS_OF_YEAR, key_parts=parts)
    rows = [_scores_of(run, quarter, stamp) for run, quarter, stamp in
            ((jan, "1998_01", "2024-01-01 00:00:00"), (again, "1998_02", "2024-02-02 00:00:00"), (feb, "1998_02", "2024-02-01 00:00:00"))]
    # one plan and one append: the runs of one snapshot share the exchanges of its claim keys
    rp.append(rows[0].unionByName(rows[1]).unionByName(rows[2]), path)
    return spark.read.parquet(path)


def _runs_sql() -> str:
    """(quarter_id, run_timestamp, overall_score) of the stored runs."""
    runs = (("1998_01", "2024-01-01 00:00:00", "v5", "claims_prev", None), ("1998_02", "2024-02-01 00:00:00", "v4", "claims_cur", "claims_prev"),
            ("1998_02", "2024-02-02 00:00:00", "v5", "claims_cur", "claims_prev"))
    return " union all ".join(
        f"select '{q}' as quarter_id, '{ts}' as run_timestamp, cast(sum(points_earned) as decimal(5,2)) as overall_score "
        f"from ({O.suite_sql(default_suite(), O.POLICIES[p], cur, prev, None, AS_OF_YEAR)})" for q, ts, p, cur, prev in runs)


def q_existing_run(spark, sf):
    scores = stored_scores(spark, sf)
    out = [rp.existing_run(scores, q).select(F.lit(q).alias("quarter_id"), "run_exists") for q in ("1998_01", "1998_02", "2031_04")]
    return out[0].unionByName(out[1]).unionByName(out[2])


REGISTRY["existing_run"] = (q_existing_run, O.with_fixtures(
    f"select q.quarter_id, count(r.quarter_id) > 0 as run_exists from (values ('1998_01'), ('1998_02'), ('2031_04')) q(quarter_id) "
    f"left join ({_runs_sql()}) r using (quarter_id) group by 1", "claims_cur", "claims_prev"))
REGISTRY["stored_scores"] = (
    lambda s, f: ts_text(stored_scores(s, f)).select("quarter_id", "run_timestamp", "overall_score"),
    O.with_fixtures(_runs_sql(), "claims_cur", "claims_prev"))


def _detail_sql(res: str) -> str:
    label = ("array_to_string(list_transform(string_split(lower(replace(category, '_', ' ')), ''), "
             "lambda x, i: case when i = 1 or not regexp_matches(string_split(lower(replace(category, '_', ' ')), '')"
             "[i - 1], '^[[:alpha:]]$') then upper(x) else x end), '')")
    return (f"select check_id, check_name, {label} as category, printf('%.1f%%', pass_rate) as pass_rate_text, "
            f"passed, failed, total, points_earned, points_possible, "
            f"cast(points_earned as varchar) || '/' || cast(points_possible as varchar) as points_text, status "
            f"from {res}")


_DETAIL_COLS = ["check_id", "check_name", "category", "pass_rate_text", "passed", "failed", "total", "points_earned",
                "points_possible", "points_text", "status"]
_rbody, _rfix = _suite_sql("root", prev=False)
REGISTRY["report_detail"] = (lambda s, f: rp.detail_table(root_run(s, f)).select(*_DETAIL_COLS),
                             O.with_fixtures(_detail_sql(f"({_rbody})"), *_rfix))
REGISTRY["report_failed_checks"] = (
    lambda s, f: rp.failed_checks_table(v5_run(s, f)).select(*_DETAIL_COLS),
    O.with_fixtures(f"select * from ({_detail_sql(f'({_body})')}) where points_earned < points_possible", *_fix))
REGISTRY["report_filter"] = (
    lambda s, f: rp.filter_results(rp.detail_table(v5_run(s, f)), ["WARN", "FAIL"], ["Logical", "Risk"])
    .select(*_DETAIL_COLS),
    O.with_fixtures(f"select * from ({_detail_sql(f'({_body})')}) where status in ('WARN', 'FAIL') "
                    f"and category in ('Logical', 'Risk')", *_fix))


_SUMMARY_COLS = ["total_checks", "passed_checks", "warning_checks", "failed_checks", "critical_issues_count"]
REGISTRY["summary_counts"] = (
    lambda s, f: v5_run(s, f).score().select(*_SUMMARY_COLS),
    O.with_fixtures(f"select {', '.join(_SUMMARY_COLS)} from ({O.score_sql(f'({_body})', O.POLICIES['v5'])})", *_fix))


def q_report_summary(spark, sf):
    run = v5_run(spark, sf)
    return rp.summary_table(run, "2024_Q1", run.total_records())


REGISTRY["report_summary"] = (q_report_summary, O.with_fixtures(
    f"select '2024_Q1' as quarter_id, s.overall_score, s.status, n.n as total_records, s.total_checks, "
    f"s.passed_checks, s.warning_checks, s.failed_checks, s.critical_issues_count "
    f"from ({O.score_sql(f'({_body})', O.POLICIES['v5'])}) s, (select count(*) as n from claims_cur) n", *_fix))

_LABEL_SQL = ("array_to_string(list_transform(string_split(lower(replace(category, '_', ' ')), ''), "
              "lambda x, i: case when i = 1 or not regexp_matches(string_split(lower(replace(category, '_', ' ')), "
              "'')[i - 1], '^[[:alpha:]]$') then upper(x) else x end), '')")
REGISTRY["report_categories"] = (
    lambda s, f: rp.category_table(root_run(s, f)),
    O.with_fixtures(
        f"select {_LABEL_SQL} as category, case when sum(points_possible) > 0 then "
        f"sum(points_earned) / sum(points_possible) * 100.0 else 0 end as percentage, "
        f"sum(points_earned) as points_earned, sum(points_possible) as points_possible "
        f"from ({_rbody}) group by category", *_rfix))


_v2body, _v2fix = _suite_sql("v2", closed=[" Closed ", "RE-CLOSED"])
REGISTRY["report_risk"] = (
    lambda s, f: rp.risk_reconciliation(v2_run(s, f)),
    O.with_fixtures(
        "select check_name, case when pass_rate = 100.0 then 'PASS - Claims data matches with risk data' "
        "else 'FAIL' end as result, printf('%.1f%%', pass_rate) as pass_rate_text, passed as matched, "
        f"failed as unmatched from ({_v2body}) where check_type = 'risk_policy_match'", *_v2fix))


def q_score_trend(spark, sf):
    """The trend over the stored runs; of February's two runs the later one counts."""
    return rp.score_trend(stored_scores(spark, sf).withColumn("business_line", F.lit("claims")))


REGISTRY["score_trend"] = (q_score_trend, O.with_fixtures(
    f"select 'claims' as business_line, quarter_id, overall_score, lag(overall_score) over w as previous_score, "
    f"overall_score - lag(overall_score) over w as score_change from (select quarter_id, "
    f"arg_max(overall_score, run_timestamp) as overall_score from ({_runs_sql()}) group by 1) "
    f"window w as (order by quarter_id)", "claims_cur", "claims_prev"))


def q_results_json(spark, sf):
    return rp.results_json(v5_run(spark, sf), "2024_Q1", RUN_TS)


_CHECK_FIELDS = ["seq", "check_id", "check_name", "check_type", "category", "subcategory", "priority", "field",
                 "points_possible", "total", "passed", "failed", "pass_rate", "points_earned", "skipped", "error",
                 "status"]
_PACKED = ", ".join(f"{c} := {c}" for c in _CHECK_FIELDS)
REGISTRY["results_json"] = (q_results_json, O.with_fixtures(
    f"""select cast(to_json(struct_pack(quarter_id := '2024_Q1', timestamp := '{RUN_TS}', total_records := n.n,
  overall_score := s.overall_score, status := s.status, total_checks := s.total_checks, passed_checks := s.passed_checks,
  warning_checks := s.warning_checks, failed_checks := s.failed_checks, critical_issues_count := s.critical_issues_count,
  risk_match_ok := s.risk_match_ok, categories := c.categories)) as varchar) as results_json
from ({O.score_sql(f'({_body})', O.POLICIES['v5'])}) s, (select count(*) as n from claims_cur) n, (
  select list(struct_pack(category := category, percentage := percentage, points_earned := earned,
                          points_possible := possible, subcategories := subs) order by seq) as categories from (
    select category, min(seq) as seq, sum(earned) as earned, sum(possible) as possible,
           case when sum(possible) > 0 then sum(earned) / sum(possible) * 100.0 else 0 end as percentage,
           list(struct_pack(subcategory := subcategory, checks := checks) order by seq) as subs from (
      select category, subcategory, min(seq) as seq, sum(points_earned) as earned, sum(points_possible) as possible,
             list(struct_pack({_PACKED}) order by seq) as checks from ({_body}) group by 1, 2) group by 1)) c""", *_fix))


# ---- premium (P11, P12, F6, F7, A18) -----------------------------------------------------------------------

_PREM = ("round_even(try_cast(building_prem as double) * flood_loading * theft_loading * subsidence_loading * 1000, 0)"
         " / 1000")
_CPREM = "round_even(contents_prem * flood_loading * theft_loading * subsidence_loading * 1000, 0) / 1000"


@register("premium_calc", O.with_fixtures(
    f"select postcode, address, {_PREM} as final_building_premium, {_CPREM} as final_contents_premium, "
    f"case when subsidence > 8 then 'Referral' else 'None' end as referral_flag from premium_input",
    "premium_input"))
def q_premium_calc(spark, sf):
    p = fx.premium_input(spark, sf)
    m = mp.premium_mapping(p.columns)
    return pm.calculate_premiums(p, m).select("postcode", "address", "final_building_premium",
                                              "final_contents_premium", "referral_flag")


@register("premium_referral", O.with_fixtures(
    "select case when subsidence > 8 then 'Referral' else 'None' end as referral_flag, count(*) as n "
    "from premium_input group by 1", "premium_input"))
def q_premium_referral(spark, sf):
    return pm.calculate_premiums(fx.premium_input(spark, sf)).groupBy("referral_flag") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("premium_totals", O.with_fixtures(
    f"select count(distinct address) as addresses_selected, round(sum({_PREM}), 3) as total_building_premium, "
    f"round(sum({_CPREM}), 3) as total_contents_premium, "
    f"count(*) filter (where subsidence > 8) as referrals from premium_input", "premium_input"))
def q_premium_totals(spark, sf):
    t = pm.premium_totals(pm.calculate_premiums(fx.premium_input(spark, sf)))
    return t.select("addresses_selected", F.round("total_building_premium", 3).alias("total_building_premium"),
                    F.round("total_contents_premium", 3).alias("total_contents_premium"), "referrals")


@register("premium_postcodes", O.with_fixtures(
    "select distinct postcode from premium_input where postcode is not null", "premium_input"))
def q_premium_postcodes(spark, sf):
    return pm.postcodes(fx.premium_input(spark, sf))


@register("premium_lookup", O.with_fixtures(
    f"select address, {_PREM} as final_building_premium, {_CPREM} as final_contents_premium, "
    f"case when subsidence > 8 then 'Referral' else 'None' end as referral_flag from premium_input "
    f"where address is not null and postcode = (select postcode from premium_input where postcode is not null "
    f"group by postcode order by count(distinct address) desc, postcode limit 1)", "premium_input"))
def q_premium_lookup(spark, sf):
    """All addresses of the postcode that has most of them."""
    p = fx.premium_input(spark, sf)
    busiest = p.where(F.col("postcode").isNotNull()).groupBy("postcode").agg(F.count_distinct("address").alias("n")) \
        .orderBy(F.desc("n"), "postcode").limit(1).select("postcode").scalar()
    rows = pm.select_addresses(p, busiest, pm.addresses(p, busiest))
    return pm.calculate_premiums(rows).select("address", "final_building_premium", "final_contents_premium",
                                              "referral_flag")


def _auto_disabled_specs():
    from veracity.plans.spec import auto_disable
    mapped = set(CLAIM_COLS) - {"uw_date"} | {"risk_policy_number"}
    return auto_disable(default_suite(include_risk=True), mapped, previous_available=False,
                        reference_available=True)[0]


def q_suite_auto_disabled(spark, sf):
    """Canonical suite under the tiered policy, with uw_date unmapped and no previous snapshot:
    checks 1.5, 5.2, 6.1 and 7.1 are disabled before planning; the rest run on the data."""
    cur = _cur(spark, sf).drop("uw_date")
    closed = TX.parse_closed_values("Closed, RE-CLOSED")
    run = run_suite(_auto_disabled_specs(), POLICIES["v1"], cur, None, fx.risk_table(spark, sf), closed, AS_OF_YEAR,
                    key_parts=fx.claim_parts(spark, sf))
    return run.checks.select(*SUITE_COLS)


def _auto_disabled_sql():
    from dataclasses import replace
    pol = replace(O.POLICIES["v1"], closed_values=("Closed", "RE-CLOSED"))
    body = O.suite_sql(_auto_disabled_specs(), pol, "claims_cur", None, "risk", AS_OF_YEAR)
    return O.with_fixtures(f"select {', '.join(SUITE_COLS)} from ({body})", "claims_cur", "risk")


REGISTRY["suite_auto_disabled"] = (q_suite_auto_disabled, _auto_disabled_sql())


# The nested declarative configuration of the fixed gross/net suite
# (ids, names, check types, formulas, bounds, priorities, points and scoring maps).
ROOT_DECLARED_CONFIG = {"validation_checks": {
    "completeness": {"critical_fields": [
        {"id": "1.1", "name": "Policy Number Complete", "field": "policy_number", "check_type": "not_null",
         "priority": "critical", "points": 3, "scoring": {100: 3, "default": 0}},
        {"id": "1.2", "name": "Claim Number Complete", "field": "claim_number", "check_type": "not_null",
         "priority": "critical", "points": 3, "scoring": {100: 3, "default": 0}}]},
    "consistency": {"financial": [
        {"id": "2.1", "name": "Gross Incurred Formula", "check_type": "formula",
         "formula": "gross_incurred = gross_paid + gross_estimate", "tolerance": 1, "priority": "critical",
         "points": 3, "scoring": {98: 3, 95: 2, 90: 1, "default": 0}},
        {"id": "2.3", "name": "Net <= Gross Relationship", "check_type": "comparison",
         "comparisons": ["net_paid <= gross_paid", "net_incurred <= gross_incurred"], "priority": "critical",
         "points": 3, "scoring": {99: 3, 97: 2, 95: 1, "default": 0}}]},
    "reasonableness": {"value_ranges": [
        {"id": "3.1", "name": "Non-Negative Financial Values", "check_type": "range",
         "fields": ["gross_paid", "gross_incurred", "net_paid", "net_incurred"], "min_value": 0,
         "priority": "critical", "points": 3, "scoring": {99.5: 3, 99: 2, 98: 1, "default": 0}},
        {"id": "3.2", "name": "Accident Year Reasonable Range", "check_type": "range", "field": "accident_year",
         "min_value": "current_year - 15", "max_value": "current_year", "priority": "high", "points": 2,
         "scoring": {99.9: 2, 99: 1, "default": 0}}]},
    "data_quality": {
        "duplicates": [
            {"id": "4.1", "name": "Unique Claim Numbers", "check_type": "duplicates", "field": "claim_number",
             "priority": "critical", "points": 3, "scoring": {100: 3, 99: 2, 97: 1, "default": 0}}],
        "format": [
            {"id": "4.3", "name": "Valid Date Formats", "check_type": "date_format",
             "fields": ["accident_date", "notification_date"], "priority": "high", "points": 2,
             "scoring": {100: 2, 99: 1, "default": 0}}]},
    "temporal_logic": {"date_sequence": [
        {"id": "5.2", "name": "Accident Before Notification", "check_type": "date_comparison",
         "comparison": "accident_date <= notification_date", "priority": "critical", "points": 3,
         "scoring": {98: 3, 95: 2, 92: 1, "default": 0}},
        {"id": "5.6", "name": "Accident Year Matches Date", "check_type": "custom",
         "function": "check_ay_matches_date", "priority": "high", "points": 2,
         "scoring": {99.9: 2, 99: 1, "default": 0}}]},
}}

_DECLARED_COLS = ["check_id", "category", "points_possible", "total", "passed", "failed", "pass_rate",
                  "points_earned", "status"]


def q_suite_root_declared(spark, sf):
    """The fixed gross/net suite driven by its declarative configuration (formula, comparison and
    range strings evaluated as Spark SQL predicates); same results as the hard-coded suite."""
    from veracity.plans.config import specs_from_config
    specs = specs_from_config(ROOT_DECLARED_CONFIG, AS_OF_YEAR)
    run = run_suite(specs, POLICIES["root"], fx.claims_root(spark, sf), as_of_year=AS_OF_YEAR)
    return run.checks.select(*_DECLARED_COLS)


_decl_body = O.suite_sql(suite_root(AS_OF_YEAR), O.POLICIES["root"], "claims_root", None, None, AS_OF_YEAR)
REGISTRY["suite_root_declared"] = (q_suite_root_declared, O.with_fixtures(
    f"select {', '.join(_DECLARED_COLS)} from ({_decl_body})", "claims_root"))


# ---- text columns, isolated checks, renamed columns, reasons ---------------------------------------------

def _text_run(policy: str, specs, closed):
    def q(spark, sf):
        run = run_suite(specs, POLICIES[policy], fx.claims_text(spark, sf, True), fx.claims_text(spark, sf, False),
                        fx.risk_table(spark, sf), closed, AS_OF_YEAR, key_parts=fx.claim_parts(spark, sf))
        return run.checks.select(*SUITE_COLS)
    body = O.suite_sql(specs, replace(O.POLICIES[policy], closed_values=tuple(closed)), "text_cur", "text_prev", "risk", AS_OF_YEAR)
    return q, O.with_fixtures(f"select {', '.join(SUITE_COLS)} from ({body})", "text_cur", "text_prev", "risk")


REGISTRY["suite_v5_text"] = _text_run("v5", default_suite(include_risk=True), ["Closed"])
REGISTRY["suite_v2_text"] = _text_run("v2", suite_v2(), ["RE-CLOSED"])


def q_suite_isolated(spark, sf):
    """Bad checks among good ones, over text columns: each bad one is a zero-point row of its own."""
    from veracity.plans.spec import CheckSpec
    meta = ("expression", "Rules", "Declared", 5)
    specs = [CheckSpec("1", "Incurred covers paid", *meta, predicate="total_incurred >= total_paid"),
             CheckSpec("2", "Zero divisor", *meta, predicate="total_paid / total_os > 1"),
             CheckSpec("3", "Not SQL", *meta, predicate="total_paid >= >= 1"),
             CheckSpec("4", "Unknown column", *meta, predicate="no_such_column > 1"),
             CheckSpec("5", "No field", "not_null", "Rules", "Declared", 5),
             CheckSpec("6", "No condition", *meta, predicate="total_paid + 1"),
             CheckSpec("7", "Unknown type", "telepathy", "Rules", "Declared", 5),
             CheckSpec("8", "Claim number", "not_null", "Rules", "Declared", 5, field="claim_number")]
    run = run_suite(specs, POLICIES["v5"], fx.claims_text(spark, sf, True), as_of_year=AS_OF_YEAR)
    return run.checks.select("check_id", "total", "passed", "failed", "points_earned", F.col("error").isNotNull().alias("has_error"))


REGISTRY["suite_isolated"] = (q_suite_isolated, O.with_fixtures(
    "with good as (select '1' as check_id, count(*) filter (where total_incurred >= total_paid) as passed, count(*) as total "
    "from text_cur union all select '2', count(*) filter (where total_paid / nullif(total_os, 0) > 1), count(*) from text_cur "
    "union all select '8', count(claim_number), count(*) from text_cur) "
    "select check_id, total, passed, total - passed as failed, case when passed * 100.0 / total > 95 then 5.0 "
    "when passed * 100.0 / total > 90 then 3.0 else 0.0 end::double as points_earned, false as has_error from good "
    "union all select unnest(['3', '4', '5', '6', '7']), 0, 0, 0, 0.0, true", "text_cur").replace("with good as", ", good as", 1)
    .replace("\n, good as", ", good as", 1))

# Other names of the claims columns, and a flat configuration that uses them.
_RENAMED = {"claim_status": "state", "total_os": "reserve", "total_incurred": "incurred", "total_paid": "paid",
            "accident_date": "loss_day", "policy_start_date": "from_day", "policy_end_date": "to_day",
            "claim_number": "claim_no", "policy_number": "policy_no"}
FLAT_CONFIG = {"checks": [
    {"id": "3.1", "name": "Closed Claim => Total OS = 0", "type": "closed_os_zero", "category": "Logical", "points": 10,
     "status_field": "state", "os_field": "reserve", "closed_status_values": ["Closed", "RE-CLOSED"], "high_pass_rate": 99.9,
     "mid_pass_rate": 80, "mid_points_factor": 0.5},
    {"id": "3.2", "name": "Date of Loss within Policy Start/End", "type": "loss_within_policy", "category": "Logical",
     "points": 10, "loss_field": "loss_day", "start_field": "from_day", "end_field": "to_day"},
    {"id": "3.3", "name": "Total Incurred = Total Paid + Total OS", "type": "incurred_equals_paid_plus_os",
     "category": "Logical", "points": 10, "incurred_field": "incurred", "paid_field": "paid", "os_field": "reserve",
     "tolerance": 5},
    {"id": "6.1", "name": "Missing Claims", "type": "missing_claims_from_prev_month", "category": "Continuity", "points": 4,
     "claim_field": "claim_no"},
    {"id": "7.1", "name": "Total Paid Non-Decreasing", "type": "total_paid_non_decreasing_vs_prev", "category": "Continuity",
     "points": 4, "claim_field": "claim_no", "paid_field": "paid"},
    {"id": "8.1", "name": "Policies in Risk Table", "type": "risk_policy_match", "category": "Risk", "points": 10,
     "policy_field": "policy_no", "risk_policy_col": "risk_policy_number"},
]}


def q_suite_renamed(spark, sf):
    """A flat configuration with its own columns, closed values and limits, over renamed columns."""
    from veracity.plans.config import specs_from_config
    cur, prev = (df.withColumnsRenamed(_RENAMED) for df in (_cur(spark, sf), _prev(spark, sf)))
    run = run_suite(specs_from_config(FLAT_CONFIG, AS_OF_YEAR), POLICIES["v1"], cur, prev, fx.risk_table(spark, sf),
                    as_of_year=AS_OF_YEAR, key_parts=fx.claim_parts(spark, sf))
    return run.checks.select("check_id", "total", "passed", "failed", "pass_rate", "points_earned", "status")


def _renamed_sql() -> str:
    wanted = {"3.1", "3.2", "3.3", "6.1", "7.1", "8.1"}
    specs = [s for s in default_suite(include_risk=True) if s.id in wanted]
    specs = [replace(s, high_pass_rate=99.9, mid_pass_rate=80.0, mid_points_factor=0.5) if s.id == "3.1" else s for s in specs]
    body = O.suite_sql(specs, replace(O.POLICIES["v1"], closed_values=("Closed", "RE-CLOSED")), "claims_cur", "claims_prev", "risk",
                       AS_OF_YEAR)
    return O.with_fixtures(f"select check_id, total, passed, failed, pass_rate, points_earned, status from ({body})",
                           "claims_cur", "claims_prev", "risk")


REGISTRY["suite_renamed"] = (q_suite_renamed, _renamed_sql())


def q_suite_root_matched(spark, sf):
    """The gross/net suite over physical column names, matched by alias."""
    df = fx.claims_root(spark, sf)
    df = df.select(*[F.col(c).alias(c.replace("_", " ").title()) for c in df.columns])
    mapping = mp.auto_match(df.columns, mp.GROSS_NET_ALIASES)
    run = run_suite(suite_root(AS_OF_YEAR), POLICIES["root"], mp.apply_mapping(df, mapping), None, fx.risk_table(spark, sf),
                    as_of_year=AS_OF_YEAR, key_parts=fx.claim_parts(spark, sf))
    return run.checks.select(*SUITE_COLS)


REGISTRY["suite_root_matched"] = (q_suite_root_matched, REGISTRY["suite_root"][1])


def q_disabled_checks(spark, sf):
    """Which checks can't run on the current snapshot as it is, why, and how many records that leaves
    unchecked."""
    from veracity.plans.spec import auto_disable, disabled_checks
    cur = _cur(spark, sf).drop("uw_date")
    reasons = auto_disable(default_suite(include_risk=True), set(cur.columns), False, False)[1]
    return disabled_checks(spark, reasons).withColumn("records", cur.agg(F.count(F.lit(1))).scalar())


REGISTRY["disabled_checks"] = (q_disabled_checks, O.with_fixtures(
    "select check_id, reason, (select count(*) from claims_cur) as records from (values ('1.5', 'Missing/unmapped columns: uw_date'), ('5.2', 'Missing/unmapped columns: uw_date'), "
    "('6.1', 'Previous bdx month not available (MoM comparisons skipped)'), "
    "('7.1', 'Previous bdx month not available (MoM comparisons skipped)'), "
    "('8.1', 'Risk database not selected')) t(check_id, reason)", "claims_cur"))


# ---- every snapshot in one job (A19 at scale) ---------------------------------------------------------

def _history_checks(spark, sf):
    from veracity.plans.history import run_suite_by_snapshot
    return run_suite_by_snapshot(default_suite(include_risk=True), POLICIES["v5"], fx.claims_history(spark, sf),
                                 "bdx_month", fx.risk_table(spark, sf), ["Closed"], AS_OF_YEAR)


def _history_sql(select: str) -> str:
    specs = default_suite(include_risk=True)
    jan = O.suite_sql(specs, O.POLICIES["v5"], "claims_prev", None, "risk", AS_OF_YEAR)
    feb = O.suite_sql(specs, O.POLICIES["v5"], "claims_cur", "claims_prev", "risk", AS_OF_YEAR)
    runs = (f"select '1998-01-01 00:00:00' as snapshot, * from ({jan}) "
            f"union all select '1998-02-01 00:00:00' as snapshot, * from ({feb})")
    return O.with_fixtures(select.format(runs=runs), "claims_cur", "claims_prev", "risk")


REGISTRY["suite_by_snapshot"] = (
    lambda spark, sf: ts_text(_history_checks(spark, sf)).select("snapshot", *SUITE_COLS),
    _history_sql("select snapshot, " + ", ".join(SUITE_COLS) + " from ({runs})"))


def _root_history(spark, sf):
    """The gross/net claims as two snapshots, by the parity of the order."""
    return fx.claims_root(spark, sf).withColumn("bdx_month", F.expr(
        "IF(CAST(split_part(substr(claim_number, 2), '-', 1) AS BIGINT) % 2 = 0, '1998-01', '1998-02')"))


def q_suite_by_snapshot_root(spark, sf):
    from veracity.plans.history import run_suite_by_snapshot
    return run_suite_by_snapshot(suite_root(AS_OF_YEAR), POLICIES["root"], _root_history(spark, sf), "bdx_month",
                                 fx.risk_table(spark, sf), as_of_year=AS_OF_YEAR).select("snapshot", *SUITE_COLS)


def _root_history_sql() -> str:
    parts, halves = [], []
    for rest, month in ((0, "1998-01"), (1, "1998-02")):
        halves.append(f"half{rest} as (select * from claims_root where "
                      f"cast(split_part(substr(claim_number, 2), '-', 1) as bigint) % 2 = {rest})")
        body = O.suite_sql(suite_root(AS_OF_YEAR), O.POLICIES["root"], f"half{rest}", None, "risk", AS_OF_YEAR)
        parts.append(f"select '{month}' as snapshot, {', '.join(SUITE_COLS)} from ({body})")
    return O.with_fixtures("@" + " union all ".join(parts), "claims_root", "risk").replace("\n@", ",\n" + ",\n".join(halves) + "\n")


REGISTRY["suite_by_snapshot_root"] = (q_suite_by_snapshot_root, _root_history_sql())


def q_score_by_snapshot(spark, sf):
    from veracity.plans.history import scores_by_snapshot
    s = scores_by_snapshot(_history_checks(spark, sf), POLICIES["v5"])
    return ts_text(s).select("snapshot", "overall_score", "status", "total_checks", "passed_checks",
                             "previous_score", "score_change")


REGISTRY["score_by_snapshot"] = (q_score_by_snapshot, _history_sql(
    "select snapshot, overall_score, status, total_checks, passed_checks, "
    "lag(overall_score) over (order by snapshot) as previous_score, "
    "overall_score - lag(overall_score) over (order by snapshot) as score_change from ("
    "select snapshot, sum(points_earned) as overall_score, count(*) as total_checks, "
    "count(*) filter (where points_possible > 0 and points_earned = points_possible) as passed_checks, "
    "case when sum(points_earned) >= 95 then 'EXCELLENT' when sum(points_earned) >= 85 then 'GOOD' "
    "when sum(points_earned) >= 75 then 'FAIR' when sum(points_earned) >= 65 then 'POOR' else 'CRITICAL' end "
    "as status from ({runs}) group by snapshot)"))


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


import veracity.catalog_arrivals  # noqa: E402,F401  (registers its queries above)
