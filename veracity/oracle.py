"""DuckDB SQL twins of the registered queries (the correctness oracle).

Fixtures as CTEs over the same parquet views, each check as plain SQL predicates, scoring as CASE
chains. What each profile expects is written out here, apart from the engine's own policies; the
suites' check lists are shared with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from veracity.plans.spec import CheckSpec, default_suite, suite_root, suite_v2


@dataclass(frozen=True)
class Expected:
    """What a profile is expected to do."""
    blank_is_null: bool
    non_negative_null: str
    valid_date_null: str
    closed_match: str
    closed_os_null: str
    loss_rule: str
    formula_empty_rate: float
    unique_keep: str
    paid_rule: str
    paid_empty_rate: float
    points_rule: str
    skip_rule: str
    omit_risk_without_table: bool
    overall_rule: str
    summary_rule: str
    closed_values: tuple[str, ...] = ("Closed",)
    empty_key_rate: float = 100.0
    status_bands: tuple[float, float, float, float] = (95.0, 85.0, 75.0, 65.0)


# The profiles, field by field.
POLICIES = {
    "v5": Expected(True, "fail", "fail", "word", "fail", "v5", 0.0, "none", "left", 0.0, "strict", "full", False, "sum", "v5"),
    "v4": Expected(False, "pass", "pass", "substring", "pass", "row_fallback", 0.0, "none", "left", 0.0, "strict", "zero",
                   False, "sum", "v5"),
    "v0": Expected(False, "pass", "pass", "substring", "pass", "row_fallback", 0.0, "none", "left", 0.0, "strict", "zero",
                   False, "sum", "v5"),
    "v3": Expected(False, "pass", "pass", "exact", "pass", "row_fallback", 0.0, "none", "left", 0.0, "linear", "zero",
                   False, "sum", "v5"),
    "v1": Expected(False, "pass", "pass", "exact", "pass", "no_fallback", 0.0, "none", "left", 0.0, "tiered", "zero",
                   False, "sum", "v5"),
    "v2": Expected(False, "drop", "fail", "case_sensitive", "fail", "drop_empty_full", 100.0, "first", "rows", 100.0,
                   "all_or_nothing", "warn", True, "percent_ex_risk", "v2"),
    "root": Expected(False, "fail", "fail", "word", "fail", "v5", 0.0, "none", "left", 0.0, "threshold", "full", False,
                     "sum", "root"),
}

_CLAIMS = """
select
  case when l_orderkey % 101 = 0 then null when l_orderkey % 103 = 0 then '  '
       else concat('P', cast(o_custkey as varchar)) end as policy_number,
  case when l_orderkey % 211 = 0 then null
       else concat({mark}, cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) end as claim_number,
  case when l_partkey % 97 = 0 then null else l_shipdate end as accident_date,
  case l_returnflag when 'R' then ' Closed ' when 'A' then 'RE-CLOSED'
       else case when l_suppkey % 7 = 0 then null when l_suppkey % 5 = 0 then 'Disclosed' else 'Open' end end
       as claim_status,
  case when l_partkey % 89 = 0 then timestamp '1900-01-01 00:00:00' when l_partkey % 83 = 0 then null
       else o_orderdate end as uw_date,
  o_orderdate as policy_start_date,
  case when l_suppkey % 11 = 0 then null else o_orderdate + interval '1' year end as policy_end_date,
  case when l_partkey % 79 = 0 then -1.0
       else {paid} + case when l_returnflag = 'N' then l_linenumber else 0 end
                   + case when l_suppkey % 13 = 0 then 7.5 else 0.0 end end::double as total_incurred,
  ({paid})::double as total_paid,
  case when l_returnflag = 'N' then cast(l_linenumber as double) when l_partkey % 71 = 0 then null
       when l_partkey % 73 = 0 then 3.0 else 0.0 end::double as total_os
from lineitem join orders on l_orderkey = o_orderkey
{extra}
"""

FIXTURES = {
    "claims_cur": _CLAIMS.format(paid="case when l_partkey % 40 = 0 then 0.5 else 1.0 end * l_quantity",
                                 mark="case when l_suppkey % 50 = 0 then 'R' else 'C' end", extra=""),
    "claims_prev": _CLAIMS.format(paid="l_quantity", mark="'C'", extra="where l_orderkey % 37 <> 0"),
    "claims_hist": """
select *, timestamp '1998-01-01 00:00:00' as bdx_month from claims_prev
union all select *, timestamp '1998-02-01 00:00:00' as bdx_month from claims_cur""",
    "claims_root": """
select case when l_orderkey % 101 = 0 then null else concat('P', cast(o_custkey as varchar)) end as policy_number,
  concat('C', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as claim_number,
  case when l_partkey % 61 = 0 then null else l_shipdate end as accident_date,
  case when l_partkey % 53 = 0 then 1970 when l_partkey % 59 = 0 then null else year(l_shipdate) end
    as accident_year,
  o_orderdate + interval '365' day as notification_date,
  l_quantity * 10 as gross_paid, l_tax * 1000 as gross_estimate,
  l_quantity * 10 + l_tax * 1000 + case when l_suppkey % 13 = 0 then 2.5 else 0.0 end as gross_incurred,
  case when l_partkey % 67 = 0 then l_quantity * 10 + 1 when l_partkey % 71 = 0 then -1.0
       else l_quantity * 10 * (1 - l_discount) end as net_paid,
  case when l_partkey % 73 = 0 then null else l_quantity * 10 end as net_incurred
from lineitem join orders on l_orderkey = o_orderkey""",
    "risk": """
select concat('P', cast(c_custkey as varchar)) as risk_policy_number,
  case when c_custkey % 17 = 0 then 0.0 else c_acctbal * 5 end as gwp
from customer where c_acctbal >= 0""",
    "premium_input": """
select concat('PC', cast(p_size as varchar)) as postcode, concat(p_brand, ' ', cast(p_partkey as varchar)) as address,
  cast(p_partkey % 10 as double) as flood_score, cast(p_partkey % 9 as double) as theft,
  case when p_partkey % 31 = 0 then null else cast(p_partkey % 12 as double) end as subsidence,
  case when p_partkey % 37 = 0 then 'n/a' else cast(p_retailprice as varchar) end as building_prem,
  p_retailprice / 4 as contents_prem, 1 + cast(p_partkey % 7 as double) / 10 as flood_loading,
  1 + cast(p_partkey % 5 as double) / 20 as theft_loading, 1 + cast(p_partkey % 3 as double) / 8 as subsidence_loading
from part""",
    "raw_dates": """
select concat('C', cast(l_orderkey as varchar)) as claim_number,
  case when l_partkey % 61 = 0 then 'bad' when l_partkey % 47 = 0 then null when l_partkey % 43 = 0 then ''
       else strftime(l_shipdate, '%Y-%m-%d') end as accident_date_raw,
  case when l_orderkey % 29 = 0 then '2024-13-45' when l_orderkey % 31 = 0 then null
       else strftime(l_shipdate, '%m/%d/%Y') end as notification_raw
from lineitem""",
}

_TEXT = """
select case when policy_number = '  ' then chr(9) || chr(10) else policy_number end as policy_number, claim_number,
  case when total_paid in (13, 17) then null else accident_date end as accident_date,
  case when claim_status = ' Closed ' then chr(9) || 'Closed' || chr(10) else claim_status end as claim_status,
  uw_date, policy_start_date, policy_end_date,
  total_incurred + 0.1 as total_incurred, case when total_paid = 23 then null else total_paid + 0.1 end as total_paid,
  case when total_os = 3 then null else total_os end as total_os
from """
FIXTURES["text_cur"] = _TEXT + "claims_cur"
FIXTURES["text_prev"] = _TEXT + "claims_prev"

_DEPS = {"claims_hist": ["claims_prev", "claims_cur"], "text_cur": ["claims_cur"], "text_prev": ["claims_prev"]}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix a query with the fixture CTEs it names (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{n} as ({FIXTURES[n]})" for n in order)
    return f"with {ctes}\n{body}" if ctes else body


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def parse_ts(col: str) -> str:
    """Text or timestamp to timestamp with the engine's fixed format list; null when unparsable."""
    return (f"try_strptime(cast({col} as varchar), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', "
            f"'%Y-%m-%d %H:%M:%S.%g', '%Y-%m-%dT%H:%M:%S.%g', '%Y-%m-%d', '%m/%d/%Y'])")


def check_sql(table: str, scope: str, ok: str, empty_rate: float = 0.0) -> str:
    return f"""select total, passed, total - passed as failed,
  case when total > 0 then passed / total * 100.0 else {empty_rate} end::double as pass_rate
from (select count(*) filter (where {scope}) as total,
             count(*) filter (where ({scope}) and coalesce({ok}, false)) as passed from {table})"""


# ---- per-check predicates by policy ----------------------------------------------------------

def closed_sql(policy: Expected, values=("Closed",)) -> str:
    m = policy.closed_match
    if m == "word":
        pat = "|".join(f"\\b{v.strip().upper()}\\b" for v in values)
        return f"coalesce(regexp_matches(upper(trim(claim_status, chr(9) || chr(10) || ' ')), '{pat}'), false)"
    if m == "substring":
        ors = " or ".join(f"contains(lower(trim(claim_status, chr(9) || chr(10) || ' ')), '{v.strip().lower()}')" for v in values)
        return f"coalesce({ors}, false)"
    if m == "exact":
        vals = ", ".join(f"'{v.strip().lower()}'" for v in values)
        return f"coalesce(lower(trim(claim_status, chr(9) || chr(10) || ' ')) in ({vals}), false)"
    vals = ", ".join(f"'{v}'" for v in values)
    return f"coalesce(claim_status in ({vals}), false)"


def row_predicates(spec: CheckSpec, policy: Expected, as_of_year: int = 2002) -> tuple[str, str, float]:
    """(scope, ok, empty_rate) SQL for a row check on a typed claims table."""
    t, f = spec.type, spec.field
    if t == "not_null":
        if policy.blank_is_null:
            blank = f" and regexp_matches(cast({f} as varchar), '[^[:space:]]')" if f in ("policy_number", "claim_number",
                                                                        "claim_status") else ""
            return "true", f"{f} is not null{blank}", 0.0
        return "true", f"{f} is not null", 0.0
    if t == "not_null_not_year_1900":
        return "true", f"{f} is not null and year({f}) <> 1900", 0.0
    if t == "non_negative":
        if policy.non_negative_null == "fail":
            return "true", f"{f} >= 0", 0.0
        if policy.non_negative_null == "pass":
            return "true", f"{f} is null or {f} >= 0", 0.0
        return f"{f} is not null", f"{f} >= 0", 100.0
    if t == "non_negative_all":
        return "true", " and ".join(f"({c} is null or {c} >= 0)" for c in spec.fields), 0.0
    if t == "valid_date":
        if policy.valid_date_null == "fail":
            return "true", f"{parse_ts(f)} is not null", 0.0
        return "true", f"{parse_ts(f)} is not null or {f} is null", 0.0
    if t == "valid_dates_all":
        return "true", " and ".join(f"({parse_ts(c)} is not null or {c} is null)" for c in spec.fields), 0.0
    if t == "year_in_range":
        y = spec.as_of_year or as_of_year
        return "true", f"{f} between {y - 15} and {y}", 0.0
    if t == "closed_os_zero":
        ok = "total_os = 0" if policy.closed_os_null == "fail" else "coalesce(total_os, 0) = 0"
        return closed_sql(policy, policy.closed_values), ok, 100.0
    if t == "loss_within_policy":
        rule = policy.loss_rule
        if rule == "v5":
            return ("accident_date is not null",
                    "accident_date >= policy_start_date and accident_date <= policy_end_date", 0.0)
        end = ("coalesce(policy_end_date, policy_start_date + interval '1' year)" if rule == "row_fallback"
               else "policy_end_date")
        scope = f"accident_date is not null and policy_start_date is not null and {end} is not null"
        return scope, f"accident_date >= policy_start_date and accident_date <= {end}", \
            100.0 if rule == "drop_empty_full" else 0.0
    if t == "incurred_equals_paid_plus_os":
        return ("total_incurred is not null and total_paid is not null and total_os is not null",
                f"abs(total_incurred - (total_paid + total_os)) <= {float(spec.tolerance or 0)}",
                policy.formula_empty_rate)
    if t == "gross_formula":
        return ("gross_incurred is not null and gross_paid is not null and gross_estimate is not null",
                f"abs(gross_incurred - (gross_paid + gross_estimate)) <= {float(spec.tolerance or 1)}", 0.0)
    if t == "net_within_gross":
        return ("net_paid is not null and gross_paid is not null and net_incurred is not null "
                "and gross_incurred is not null", "net_paid <= gross_paid and net_incurred <= gross_incurred", 0.0)
    if t == "date_sequence":
        a, b = spec.fields
        return f"{a} is not null and {b} is not null", f"{a} <= {b}", 0.0
    if t == "year_matches_date":
        y, d = spec.fields
        return f"{y} is not null and {d} is not null", f"{y} = year({d})", 0.0
    raise KeyError(t)


def key_check_sql(spec: CheckSpec, policy: Expected, cur: str, prev: str | None, risk: str | None) -> tuple[str, float]:
    """(select total, passed, failed) SQL for a key check, and its empty-scope rate."""
    t = spec.type
    if t == "unique":
        f = spec.field
        if policy.unique_keep == "none":
            return (f"select sum(n) as total, sum(n) - sum(case when n > 1 then n else 0 end) as passed, "
                    f"sum(case when n > 1 then n else 0 end) as failed "
                    f"from (select {f}, count(*) as n from {cur} group by {f})"), 0.0
        return (f"select sum(n) as total, count(*) as passed, sum(n) - count(*) as failed "
                f"from (select {f}, count(*) as n from {cur} group by {f})"), 0.0
    if t == "missing_claims_from_prev_month":
        return (f"select count(*) as total, count(c.k) as passed, count(*) - count(c.k) as failed from "
                f"(select distinct claim_number as k from {prev} where claim_number is not null) p "
                f"left join (select distinct claim_number as k from {cur} where claim_number is not null) c "
                f"on p.k = c.k"), policy.empty_key_rate
    if t == "total_paid_non_decreasing_vs_prev":
        if policy.paid_rule == "left":
            ok = "coalesce(p.v is null and c.v is not null or c.v >= p.v, false)"
            return (f"select count(*) as total, count(*) filter (where {ok}) as passed, "
                    f"count(*) - count(*) filter (where {ok}) as failed from "
                    f"(select claim_number as k, sum(total_paid::decimal(28, 6)) as v from {cur} where claim_number is not null "
                    f"group by 1) c left join (select claim_number as k, sum(total_paid::decimal(28, 6)) as v from {prev} "
                    f"where claim_number is not null group by 1) p on c.k = p.k"), policy.paid_empty_rate
        return (f"select count(*) as total, count(*) filter (where c.total_paid >= p.total_paid) as passed, "
                f"count(*) - count(*) filter (where c.total_paid >= p.total_paid) as failed "
                f"from {cur} c join {prev} p on c.claim_number is not distinct from p.claim_number"), \
            policy.paid_empty_rate
    if t == "risk_policy_match":
        return (f"select count(*) as total, count(r.k) as passed, count(*) - count(r.k) as failed from "
                f"(select distinct policy_number as k from {cur} where policy_number is not null) c "
                f"left join (select distinct risk_policy_number as k from {risk} "
                f"where risk_policy_number is not null) r on c.k = r.k"), policy.empty_key_rate
    if t == "loss_ratio":
        ok = "coalesce(a.v / nullif(r.gwp, 0) between 0 and 1.5, false)"
        return (f"select count(*) as total, count(*) filter (where {ok}) as passed, "
                f"count(*) - count(*) filter (where {ok}) as failed from "
                f"(select policy_number as k, coalesce(sum(gross_incurred), 0) as v from {cur} "
                f"where policy_number is not null group by 1) a join {risk} r on a.k = r.risk_policy_number"), 0.0
    raise KeyError(t)


def failing_sql(spec: CheckSpec, policy: Expected, cur: str, prev: str | None, risk: str | None) -> str:
    """The identifiers of a check's failing rows, as column ``record``."""
    t = spec.type
    try:
        scope, ok, _ = row_predicates(spec, policy)
        return f"select claim_number as record from {cur} where ({scope}) and not coalesce({ok}, false)"
    except KeyError:
        pass
    if t == "unique":
        return (f"select claim_number as record from (select claim_number, count(*) over (partition by claim_number) as n "
                f"from {cur}) where n > 1")
    if t == "missing_claims_from_prev_month":
        return (f"select claim_number as record from {prev} where claim_number is not null "
                f"except select claim_number from {cur}")
    if t == "total_paid_non_decreasing_vs_prev" and policy.paid_rule == "left":
        return (f"select c.k as record from (select claim_number as k, sum(total_paid::decimal(28, 6)) as v from {cur} "
                f"where claim_number is not null group by 1) c left join (select claim_number as k, "
                f"sum(total_paid::decimal(28, 6)) as v from {prev} where claim_number is not null group by 1) p on c.k = p.k "
                f"where not coalesce(p.v is null and c.v is not null or c.v >= p.v, false)")
    if t == "total_paid_non_decreasing_vs_prev":
        return (f"select c.claim_number as record from {cur} c join (select claim_number, max(total_paid) as most, "
                f"count(*) - count(total_paid) as nulls from {prev} group by 1) p "
                f"on c.claim_number is not distinct from p.claim_number "
                f"where c.total_paid is null or p.nulls > 0 or c.total_paid < p.most")
    if t == "risk_policy_match":
        return (f"select distinct policy_number as record from {cur} where policy_number is not null and policy_number "
                f"not in (select risk_policy_number from {risk} where risk_policy_number is not null)")
    raise KeyError(t)


def failing_records_sql(specs: list[CheckSpec], policy: Expected, cur: str, prev: str, risk: str) -> str:
    """(check_id, record) of all enabled checks."""
    return " union all ".join(f"select '{s.id}' as check_id, record from ({failing_sql(s, policy, cur, prev, risk)})"
                              for s in specs if s.enabled)


def points_sql(spec: CheckSpec, policy: Expected, rate: str = "pass_rate") -> str:
    pp = float(spec.points)
    r = f"least(greatest(coalesce({rate}, 0), 0), 100)"
    rule = policy.points_rule
    if rule == "strict":
        if pp <= 0:
            return "0.0"
        return f"(case when {r} > 95 then floor({pp}) when {r} > 90 then floor({pp} * 0.6) else 0 end)::double"
    if rule == "tiered":
        mid = f"greatest(0, least(floor({pp}), round_even({pp} * {spec.mid_points_factor}, 0)))"
        if pp <= 0:
            return "0.0"
        return (f"(case when {rate} >= {spec.high_pass_rate} then {pp} when {rate} >= {spec.mid_pass_rate} "
                f"then {mid} else 0 end)::double")
    if rule == "linear":
        return "0.0" if pp <= 0 else f"({pp} * ({r} / 100.0))::double"
    if rule == "all_or_nothing":
        return f"(case when {rate} >= {spec.full_at} then {pp} else 0 end)::double"
    if rule == "threshold":
        whens = " ".join(f"when {rate} >= {float(t)} then {float(p)}"
                         for t, p in sorted(spec.thresholds, key=lambda x: -x[0]))
        return f"(case {whens} else 0 end)::double"
    raise KeyError(rule)


def suite_sql(specs: list[CheckSpec], policy: Expected, cur: str, prev: str | None, risk: str | None,
              as_of_year: int = 2002) -> str:
    """Per-check result rows (seq, check_id, ..., pass_rate, points_earned, status) of a whole suite."""
    parts = []
    seq = -1
    for spec in specs:
        if not spec.enabled:
            continue
        seq += 1
        if spec.type in ("risk_policy_match", "loss_ratio") and risk is None and \
                (policy.omit_risk_without_table or spec.type == "loss_ratio"):
            continue
        meta = (f"{seq} as seq, '{spec.id}' as check_id, '{spec.name}' as check_name, '{spec.type}' as check_type, "
                f"'{spec.category}' as category, '{spec.subcategory}' as subcategory, '{spec.priority}' as priority, "
                f"{float(spec.points)}::double as points_possible, "
                f"'{spec.field or ','.join(spec.fields)}' as field, null::varchar as error")
        needs = (spec.type in ("missing_claims_from_prev_month", "total_paid_non_decreasing_vs_prev") and prev is None) \
            or (spec.type in ("risk_policy_match", "loss_ratio") and risk is None)
        if needs:
            if policy.skip_rule == "full":
                parts.append(f"select {meta}, 0::bigint as total, 0::bigint as passed, 0::bigint as failed, "
                             f"100.0::double as pass_rate, {float(spec.points)}::double as points_earned, "
                             f"true as skipped")
            else:
                earned = "0.0" if policy.skip_rule == "warn" else points_sql(spec, policy, "0.0")
                parts.append(f"select {meta}, 0::bigint as total, 0::bigint as passed, 0::bigint as failed, "
                             f"0.0::double as pass_rate, ({earned})::double as points_earned, true as skipped")
            continue
        try:
            scope, ok, empty = row_predicates(spec, policy, as_of_year)
            body = check_sql(cur, scope, ok, empty)
        except KeyError:
            sql, empty = key_check_sql(spec, policy, cur, prev, risk)
            body = (f"select total, passed, failed, case when total > 0 then passed / total * 100.0 "
                    f"else {empty} end::double as pass_rate from ({sql})")
        parts.append(f"select {meta}, total::bigint as total, passed::bigint as passed, failed::bigint as failed, "
                     f"pass_rate, {points_sql(spec, policy)} as points_earned, false as skipped from ({body})")
    union = "\nunion all\n".join(parts)
    return (f"select *, case when points_earned = points_possible then 'PASS' when points_earned > 0 then 'WARN' "
            f"else 'FAIL' end as status from ({union})")


def score_sql(results: str, policy: Expected) -> str:
    """One row: overall score, status and summary counts over a results relation."""
    risk = "check_type = 'risk_policy_match'"
    if policy.overall_rule == "sum":
        overall = "coalesce(sum(points_earned), 0)"
    else:
        overall = (f"case when sum(points_possible) filter (where not {risk}) > 0 then "
                   f"sum(points_earned) filter (where not {risk}) / sum(points_possible) filter (where not {risk}) "
                   f"* 100.0 else 0 end")
    pe, pp = "points_earned", "points_possible"
    if policy.summary_rule == "v5":
        counts = (f"count(*) as total_checks, count(*) filter (where {pp} > 0 and {pe} = {pp}) as passed_checks, "
                  f"count(*) filter (where {pp} > 0 and {pe} <> {pp} and {pe} <> 0) as warning_checks, "
                  f"count(*) filter (where {pp} > 0 and {pe} <> {pp} and {pe} = 0) as failed_checks, "
                  f"0 as critical_issues_count")
    elif policy.summary_rule == "root":
        counts = (f"count(*) as total_checks, count(*) filter (where {pe} = {pp}) as passed_checks, "
                  f"count(*) filter (where {pe} <> {pp} and {pe} > 0) as warning_checks, "
                  f"count(*) filter (where {pe} <> {pp} and not {pe} > 0) as failed_checks, "
                  f"count(*) filter (where {pe} <> {pp} and not {pe} > 0 and priority = 'critical') "
                  f"as critical_issues_count")
    else:
        counts = (f"count(*) filter (where not {risk}) as total_checks, "
                  f"count(*) filter (where not {risk} and {pe} = {pp}) as passed_checks, "
                  f"count(*) filter (where not {risk}) - count(*) filter (where not {risk} and {pe} = {pp}) "
                  f"- count(*) filter (where not {risk} and {pe} = 0) as warning_checks, "
                  f"count(*) filter (where not {risk} and {pe} = 0) as failed_checks, 0 as critical_issues_count")
    e, g, f, p = policy.status_bands
    return (f"select overall_score, total_checks::bigint as total_checks, passed_checks::bigint as passed_checks, "
            f"warning_checks::bigint as warning_checks, failed_checks::bigint as failed_checks, "
            f"critical_issues_count::bigint as critical_issues_count, risk_match_ok, "
            f"case when overall_score >= {e} then 'EXCELLENT' when overall_score >= {g} then 'GOOD' "
            f"when overall_score >= {f} then 'FAIR' when overall_score >= {p} then 'POOR' else 'CRITICAL' end "
            f"as status from (select ({overall})::double as overall_score, {counts}, "
            f"coalesce(bool_or(pass_rate = 100.0) filter (where {risk}), false) as risk_match_ok from {results})")


__all__ = ["FIXTURES", "with_fixtures", "check_sql", "row_predicates", "key_check_sql", "points_sql",
           "suite_sql", "score_sql", "POLICIES", "default_suite", "suite_root", "suite_v2", "ts_text", "parse_ts"]
