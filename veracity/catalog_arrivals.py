"""Registered queries on what is kept between runs: key states, stored runs, failing rows in one pass, elected date layouts,
file sets, metadata counts and checks counted while loading."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity import catalog as base
from veracity import oracle as O
from veracity.catalog import AS_OF_YEAR, CLAIM_COLS, CLAIM_SQL_COLS, RUN_TS, SUITE_COLS, register, ts_text
from veracity.functions import elect
from veracity.operators import keychecks as kc
from veracity.plans import reports as rp
from veracity.plans.arrival import Arrivals
from veracity.plans.config import specs_from_config
from veracity.plans.keystate import ArrivedKeys, KeyStates
from veracity.plans.runstore import RunStore
from veracity.plans.spec import POLICIES, default_suite
from veracity.plans.suite import CONTEXT_COLUMNS, SuiteRun, run_suite
from veracity.session import checkpoint_dir
from veracity.sources import files, metadata
from veracity.sources import fixtures as fx


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/veracity-{what}-{uuid.uuid4().hex}"


# ---- J1, J3, J4 from key states ---------------------------------------------------------------------------

def arrived_keys(spark, sf) -> ArrivedKeys:
    """January recorded when it came; February arrives."""
    states = KeyStates(spark, fresh_folder(spark, "keys"), buckets=8)
    states.record(fx.PREVIOUS_BDX, fx.claims_snapshot(spark, sf, False))
    return states.arrive(fx.CURRENT_BDX, fx.claims_snapshot(spark, sf, True))


def _key_sql(kind: str, field: str | None = None) -> str:
    return O.key_check_sql(base._spec(kind, field), O.POLICIES["v5"], "claims_cur", "claims_prev", None)[0]


@register("j_arriving_month", O.with_fixtures(" union all ".join(
    f"select '{name}' as check_name, total::bigint as total, passed::bigint as passed, failed::bigint as failed from ({sql})"
    for name, sql in (("unique", _key_sql("unique", "claim_number")), ("missing", _key_sql("missing_claims_from_prev_month")),
                      ("paid", _key_sql("total_paid_non_decreasing_vs_prev")))), "claims_cur", "claims_prev"))
def q_arriving_month(spark, sf):
    counts = arrived_keys(spark, sf).profile()
    rows = [("unique", "u_total", "u_total - u_failed"), ("missing", "m_total", "m_passed"), ("paid", "p_total", "p_passed")]
    return counts.selectExpr("inline(array(" + ", ".join(
        f"named_struct('check_name', '{n}', 'total', {t}, 'passed', {p}, 'failed', {t} - ({p}))" for n, t, p in rows) + "))")


@register("j_arriving_keys", O.with_fixtures(" union all ".join(
    f"select '{name}' as check_name, record as claim_number from ({O.failing_sql(base._spec(kind), O.POLICIES['v5'], 'claims_cur', 'claims_prev', None)})"
    for name, kind in (("missing", "missing_claims_from_prev_month"), ("paid", "total_paid_non_decreasing_vs_prev")))
    + " union all select 'unique' as check_name, claim_number from claims_cur group by claim_number having count(*) > 1",
    "claims_cur", "claims_prev"))
def q_arriving_keys(spark, sf):
    keys = arrived_keys(spark, sf)
    parts = [df.select(F.lit(name).alias("check_name"), "claim_number")
             for name, df in (("missing", keys.missing()), ("paid", keys.decreased()), ("unique", keys.duplicated()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def arriving_run(spark, sf, **more) -> SuiteRun:
    """The canonical suite on the arriving snapshot; the previous claims are not read."""
    return run_suite(default_suite(include_risk=True), POLICIES["v5"], fx.claims_snapshot(spark, sf, True), None,
                     fx.risk_table(spark, sf), ["Closed"], AS_OF_YEAR, keys=arrived_keys(spark, sf), **more)


@register("suite_arriving", base.REGISTRY["suite_v5"][1])
def q_suite_arriving(spark, sf):
    return arriving_run(spark, sf).checks.select(*SUITE_COLS)


@register("suite_while_loading", base.REGISTRY["suite_v5"][1])
def q_suite_while_loading(spark, sf):
    """Row checks counted by the write that stores the snapshot."""
    return arriving_run(spark, sf, store_to=fresh_folder(spark, "snapshot")).checks.select(*SUITE_COLS)


# ---- S9 to S12: runs stored as a whole ----------------------------------------------------------------------

def stored_runs(spark, sf) -> RunStore:
    """January; February under an older policy; March killed before its commit; February again, in place of the first; a repeat of the
    last with its own id, which is stored once."""
    store = RunStore(spark, fresh_folder(spark, "runs"))
    cur, prev = fx.claims_snapshot(spark, sf, True), fx.claims_snapshot(spark, sf, False)
    parts = fx.claim_parts(spark, sf)

    def run(policy: str, current: DataFrame, previous: DataFrame | None, store_to: str | None = None) -> SuiteRun:
        return run_suite(default_suite(), POLICIES[policy], current, previous, None, ["Closed"], AS_OF_YEAR, store_to=store_to,
                         key_parts=parts)
    # each snapshot is stored by its first run and read from there by all that follows
    january = run("v5", prev, None, fresh_folder(spark, "snapshot"))
    prev = january.current
    store.save(january, "1998_01", "2024-01-01 00:00:00")
    first = run("v4", cur, prev, fresh_folder(spark, "snapshot"))
    cur = first.current
    store.save(first, "1998_02", "2024-02-01 00:00:00")
    results = rp.dq_check_results(first, "1998_03", "2024-03-01 00:00:00", with_json=False)
    store.stage("killed", "1998_03", {"dq_check_results": results, "dq_issues": rp.dq_issues(results)})
    again = run("v5", cur, prev)
    for _ in range(2):
        store.save(again, "1998_02", "2024-02-02 00:00:00", replace=True, run_id="february")
    return store


_VISIBLE = (("1998_01", "2024-01-01 00:00:00", "claims_prev", None), ("1998_02", "2024-02-02 00:00:00", "claims_cur", "claims_prev"))


def _visible_sql(select: str) -> str:
    return " union all ".join(select.format(q=q, ts=ts, body=O.suite_sql(default_suite(), O.POLICIES["v5"], cur, prev, None, AS_OF_YEAR))
                              for q, ts, cur, prev in _VISIBLE)


@register("runs_scores", O.with_fixtures(_visible_sql(
    "select '{q}' as quarter_id, '{ts}' as run_timestamp, cast(sum(points_earned) as decimal(5,2)) as overall_score, "
    "count(*) as total_checks from ({body})"), "claims_cur", "claims_prev"))
def q_runs_scores(spark, sf):
    return ts_text(stored_runs(spark, sf).read("dq_scores")).select("quarter_id", "run_timestamp", "overall_score", "total_checks")


@register("runs_issues", O.with_fixtures(_visible_sql(
    "select '{q}' as quarter_id, check_id, failed as failed_count, total as total_count, false as resolved from ({body}) "
    "where points_earned < points_possible"), "claims_cur", "claims_prev"))
def q_runs_issues(spark, sf):
    return stored_runs(spark, sf).read("dq_issues").select("quarter_id", "check_id", "failed_count", "total_count", "resolved")


@register("runs_of_quarter", O.with_fixtures(
    f"select check_id, pass_rate::decimal(5,2) as pass_rate, points_earned, status from "
    f"({O.suite_sql(default_suite(), O.POLICIES['v5'], 'claims_cur', 'claims_prev', None, AS_OF_YEAR)})", "claims_cur", "claims_prev"))
def q_runs_of_quarter(spark, sf):
    return stored_runs(spark, sf).read("dq_check_results", "1998_02").select("check_id", "pass_rate", "points_earned", "status")


@register("runs_trend", O.with_fixtures(
    "select quarter_id, overall_score, lag(overall_score) over (order by quarter_id) as previous_score from (" + _visible_sql(
        "select '{q}' as quarter_id, cast(sum(points_earned) as decimal(5,2)) as overall_score from ({body})") + ")",
    "claims_cur", "claims_prev"))
def q_runs_trend(spark, sf):
    scores = stored_runs(spark, sf).read("dq_scores").withColumn("business_line", F.lit("motor"))
    return rp.score_trend(scores).select("quarter_id", "overall_score", "previous_score")


@register("runs_existing", O.with_fixtures(
    "select q.quarter_id, count(c.claim_number) > 0 as run_exists from (values ('1998_01'), ('1998_02'), ('1998_03')) q(quarter_id) "
    "left join (select '1998_01' as quarter_id, claim_number from claims_prev union all select '1998_02', claim_number from claims_cur) c "
    "using (quarter_id) group by 1", "claims_cur", "claims_prev"))
def q_runs_existing(spark, sf):
    store = stored_runs(spark, sf)
    parts = [store.existing_run(q).select(F.lit(q).alias("quarter_id"), "run_exists") for q in ("1998_01", "1998_02", "1998_03")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- a month from arrival to stored run ---------------------------------------------------------------------------

def received(spark, sf) -> Arrivals:
    arrivals = Arrivals(spark, fresh_folder(spark, "arrivals"), buckets=8)
    for month, quarter, current in ((fx.PREVIOUS_BDX, "1998_01", False), (fx.CURRENT_BDX, "1998_02", True)):
        arrivals.receive(month, fx.claims_snapshot(spark, sf, current), default_suite(include_risk=True), POLICIES["v5"], quarter, RUN_TS,
                         fx.risk_table(spark, sf), ["Closed"], AS_OF_YEAR)
    return arrivals


@register("arrival_results", base.REGISTRY["dq_check_results"][1].replace("'2024_Q1'", "'1998_02'"))
def q_arrival_results(spark, sf):
    return ts_text(received(spark, sf).runs.read("dq_check_results", "1998_02"))


@register("arrival_snapshots", O.with_fixtures(
    f"select {O.ts_text('bdx_month')} as snapshot, record_count, {O.ts_text('lag(bdx_month) over (order by bdx_month)')} as previous_snapshot "
    f"from (select bdx_month, count(*) as record_count from claims_hist group by bdx_month)", "claims_hist"))
def q_arrival_snapshots(spark, sf):
    return received(spark, sf).snapshots()


# ---- J9: failing rows of all checks in one pass ---------------------------------------------------------------

_SHOWN = [c for c in CLAIM_COLS if any(c in cols or "check_field" in cols for cols in CONTEXT_COLUMNS.values())]


def _failing_sql() -> str:
    """Every check's failing rows by itself, united."""
    policy, parts = O.POLICIES["v5"], []
    for spec in default_suite(include_risk=True):
        if not spec.enabled:
            continue
        try:
            scope, ok, _ = O.row_predicates(spec, policy)
            where = f"({scope}) and not coalesce({ok}, false)"
        except KeyError:
            where = None
        if where is None and spec.type != "unique":
            label = rp.IDENTIFIER_LABELS[spec.type]
            cols = ", ".join(f"null::varchar as {c}" for c in _SHOWN)
            parts.append(f"select '{spec.id}' as check_id, {cols}, '{label}' as identifier_label, record as identifier "
                         f"from ({O.failing_sql(spec, policy, 'claims_cur', 'claims_prev', 'risk')})")
            continue
        if where is None:
            where = ("claim_number in (select claim_number from claims_cur group by 1 having count(*) > 1) or (claim_number is null "
                     "and (select count(*) from claims_cur where claim_number is null) > 1)")
        shown = {spec.field if c == "check_field" else c for c in CONTEXT_COLUMNS[spec.type]}
        cols = ", ".join(f"{O.ts_text(c) if c.endswith('date') else c + '::varchar'} as {c}" if c in shown else f"null::varchar as {c}" for c in _SHOWN)
        parts.append(f"select '{spec.id}' as check_id, {cols}, null as identifier_label, null as identifier from claims_cur where {where}")
    return " union all ".join(parts)


@register("failing_rows_once", O.with_fixtures(_failing_sql(), "claims_cur", "claims_prev", "risk"))
def q_failing_rows_once(spark, sf):
    rows = ts_text(rp.failing_rows(arriving_run(spark, sf)))
    return rows.select("check_id", *(F.col(c).cast("string").alias(c) for c in _SHOWN), "identifier_label", "identifier")


# ---- P5: elected date layouts -----------------------------------------------------------------------------------

ENTERED = ["accident_date", "uw_date", "policy_start_date", "policy_end_date", "bdx_month"]
# The layouts that stand for election in the query, in order, and their names in the SQL twin.
SQL_LAYOUTS = {"yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd": "%Y-%m-%d", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y",
               "dd-MM-yyyy": "%d-%m-%Y", "dd.MM.yyyy": "%d.%m.%Y"}

O.FIXTURES["dates_as_entered"] = """
select concat('C', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as claim_number,
  case when l_partkey % 61 = 0 then 'bad' when l_partkey % 47 = 0 then null when l_partkey % 43 = 0 then ' '
       when l_partkey % 5 = 0 then strftime(l_shipdate, '%Y-%m-%d') else strftime(l_shipdate, '%d/%m/%Y') end as accident_date,
  case when l_suppkey % 4 = 0 then strftime(l_shipdate, '%d/%m/%Y') else ' ' || strftime(l_shipdate, '%m/%d/%Y') end as uw_date,
  strftime(date_trunc('month', l_shipdate) + to_days(l_linenumber::int), '%d/%m/%Y') as policy_start_date,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as policy_end_date,
  case when l_partkey % 2 = 0 then 'soon' end as bdx_month
from lineitem"""


def _votes_sql(column: str) -> str:
    votes = " union all ".join(f"select {k} as k, '{name}' as layout, count(try_strptime(trim({column}), '{fmt}')) as votes from dates_as_entered"
                               for k, (name, fmt) in enumerate(SQL_LAYOUTS.items()))
    return f"select *, row_number() over (order by votes desc, k) as place from ({votes})"


def _elected_sql(column: str) -> str:
    winner = f"(select case when votes > 0 then layout end from ({_votes_sql(column)}) where place = 1)"
    cases = " ".join(f"when '{name}' then try_strptime(trim({column}), '{fmt}')" for name, fmt in SQL_LAYOUTS.items())
    return f"{O.ts_text(f'case {winner} {cases} end')} as {column}"


@register("coerce_elected", O.with_fixtures(f"select claim_number, {', '.join(map(_elected_sql, ENTERED))} from dates_as_entered", "dates_as_entered"))
def q_coerce_elected(spark, sf):
    return ts_text(elect.elect_dates(fx.dates_as_entered(spark, sf), ENTERED, list(SQL_LAYOUTS)))


@register("coerce_elected_layouts", O.with_fixtures(" union all ".join(
    f"select '{c}' as column, (select count(*) from dates_as_entered where trim({c}) <> '') as n_values, "
    f"max(case when place = 1 and votes > 0 then layout end) as layout, max(case when place = 1 then votes end) as votes, "
    f"max(case when place = 2 and votes > 0 then layout end) as runner_up, max(case when place = 2 then votes end) as runner_up_votes, "
    f"max(case when place = 1 then votes end) > 0 and max(case when place = 1 then votes end) = max(case when place = 2 then votes end) as ambiguous "
    f"from ({_votes_sql(c)})" for c in ENTERED), "dates_as_entered"))
def q_coerce_elected_layouts(spark, sf):
    return elect.elected_layouts(fx.dates_as_entered(spark, sf), ENTERED, list(SQL_LAYOUTS))


# ---- S1, S4, S5, S6, S8, F1 over files and metadata ------------------------------------------------------------

@register("snap_metadata", O.with_fixtures(
    f"select {O.ts_text('bdx_month')} as bdx_month, record_count, {O.ts_text('lag(bdx_month) over (order by bdx_month)')} as previous_snapshot "
    f"from (select bdx_month, count(*) as record_count from claims_hist group by bdx_month)", "claims_hist"))
def q_snap_metadata(spark, sf):
    path = fresh_folder(spark, "history")
    fx.claims_history(spark, sf).write.partitionBy("bdx_month").parquet(path)
    return ts_text(metadata.snapshot_list(spark, path))


# The headings of two file sets; the third has the logical names.
HEADINGS = {"policy_number": ("Policy Number", "PolNum"), "claim_number": ("Claim_Number", "ClmNum"), "accident_date": ("Date of Loss", "DOL"),
            "claim_status": ("Status", "ClaimStatus"), "uw_date": ("UW Date", "UW_Date"), "policy_start_date": ("Start Date", "Policy_Start_Date"),
            "policy_end_date": ("Expiry Date", "End Date"), "total_incurred": ("Incurred", "Incurred Amount"), "total_paid": ("Paid Amount", "Paid"),
            "total_os": ("Outstanding", "OS")}
_KEEP_SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def file_sets(spark, sf) -> list[tuple[str, str]]:
    """The current claims as three uploads: Parquet, CSV and JSON, each with its own headings, the Parquet one in two folders."""
    claims = fx.claims_snapshot(spark, sf, True).withColumn("__set", F.pmod(F.xxhash64("claim_number", "total_paid"), F.lit(4)))
    root, out = fresh_folder(spark, "uploads"), []
    for i, fmt in enumerate(("parquet", "parquet", "csv", "json")):
        rows = claims.where(F.col("__set") == i).drop("__set")
        if fmt == "csv":
            rows = ts_text(rows)
        heading = {"parquet": 0, "csv": 1}.get(fmt)
        if heading is not None:
            rows = rows.select(*(F.col(c).alias(HEADINGS[c][heading]) for c in rows.columns))
        writer = rows.write.format(fmt).options(**(_KEEP_SPACES if fmt == "csv" else {}))
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{root}/set{i}")
        out.append((f"{root}/set{i}", fmt))
    return out


@register("snap_files", O.with_fixtures(
    f"select {O.ts_text('bdx_month')} as snapshot, count(*) as n_claims, count(distinct policy_number) as n_policies from claims_hist "
    f"group by 1", "claims_hist"))
def q_snap_files(spark, sf):
    """An upload whose snapshot column is found by its name and holds text (S8 in file mode): each listed month is loaded by its value."""
    path = fresh_folder(spark, "upload")
    history = ts_text(fx.claims_history(spark, sf)).select("claim_number", "policy_number", F.col("bdx_month").alias("BDX Month"), "accident_date")
    history.write.option("header", True).options(**_KEEP_SPACES).csv(path)
    upload = files.read_files(spark, path, "csv", "claim_number string, policy_number string, `BDX Month` string, accident_date string")
    months = [str(r.snapshot) for r in files.list_file_snapshots(upload).collect()]                # a row a month
    parts = [files.load_file_snapshot(upload, m).agg(F.lit(m).alias("snapshot"), F.count(F.lit(1)).alias("n_claims"),
                                                     F.count_distinct("policy_number").alias("n_policies")) for m in months]
    return reduce(DataFrame.unionByName, parts)


@register("files_united", O.with_fixtures(f"select {CLAIM_SQL_COLS} from claims_cur", "claims_cur"))
def q_files_united(spark, sf):
    return ts_text(files.read_file_sets(spark, file_sets(spark, sf), options={"csv": _KEEP_SPACES})).select(*CLAIM_COLS)


# ---- K14 by function name, J7 ----------------------------------------------------------------------------------

# Custom checks by the names of two session functions.
CUSTOM_CONFIG = {"checks": {"custom": {"rules": [
    {"id": "c1", "name": "Incurred near paid", "check_type": "custom", "function": "veracity_near", "fields": ["total_incurred", "total_paid"], "points": 5,
     "scoring": {90: 5, "default": 0}},
    {"id": "c2", "name": "Status known", "check_type": "custom", "function": "veracity_known_status", "field": "claim_status", "points": 5,
     "scoring": {99: 5, "default": 0}, "skip_nulls": False}]}}}


def q_k_custom(spark, sf):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION veracity_near(a DOUBLE, b DOUBLE) RETURNS BOOLEAN RETURN abs(a - b) <= 7")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION veracity_known_status(s STRING) RETURNS BOOLEAN "
              "RETURN lower(trim(s)) IN ('open', 'closed', 're-closed')")
    run = run_suite(specs_from_config(CUSTOM_CONFIG, AS_OF_YEAR), POLICIES["root"], fx.claims_snapshot(spark, sf, True), as_of_year=AS_OF_YEAR)
    return run.checks.select("check_id", "total", "passed", "failed", "points_earned", F.col("error").isNotNull().alias("has_error"))


register("k_custom", O.with_fixtures(
    "select check_id, total, passed, total - passed as failed, case when 100.0 * passed / total >= least_rate then 5.0 else 0.0 end::double as points_earned, "
    "false as has_error from (select 'c1' as check_id, 90 as least_rate, count(*) filter (where total_incurred is not null and total_paid is not null) as total, "
    "count(*) filter (where abs(total_incurred - total_paid) <= 7) as passed from claims_cur union all "
    "select 'c2', 99, count(*), count(*) filter (where lower(trim(claim_status)) in ('open', 'closed', 're-closed')) from claims_cur)", "claims_cur"))(q_k_custom)


@register("j_risk_fallback", O.with_fixtures(
    "select 'PolicyNumber' as risk_key, total::bigint as total, passed::bigint as passed, failed::bigint as failed from ("
    + O.key_check_sql(base._spec("risk_policy_match"), O.POLICIES["v5"], "claims_cur", None, "risk")[0]
    + ") union all select 'none', count(*), 0, count(*) from claims_cur", "claims_cur", "risk"))
def q_risk_fallback(spark, sf):
    """The reference key found under another name (J7), and a reference table with none of the names."""
    cur, risk = fx.claims_snapshot(spark, sf, True), fx.risk_table(spark, sf)
    spec = [s for s in default_suite(include_risk=True) if s.type == "risk_policy_match"]
    out = []
    for name in ("PolicyNumber", "reference"):
        renamed = risk.withColumnRenamed("risk_policy_number", name)
        found = kc.resolve_risk_key(renamed, "risk_policy_number") or "none"
        run = run_suite(spec, POLICIES["v5"], cur, None, renamed, as_of_year=AS_OF_YEAR)
        out.append(run.checks.select(F.lit(found).alias("risk_key"), "total", "passed", "failed"))
    return out[0].unionByName(out[1])
