"""Points, status bands and rollups as Column expressions over check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.plans.spec import CheckSpec, Policy


def _d(x: float) -> str:
    """A double literal in Spark SQL text."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def _clamp_sql(rate: str) -> str:
    return f"greatest({_d(0)}, least({_d(100)}, coalesce({rate}, {_d(0)})))"


# The points rules are written once as Spark SQL text, so a whole suite's result rows are one
# ``selectExpr`` (parsed JVM-side) rather than hundreds of Column calls from Python.

# A5
def points_strict_sql(possible: str, rate: str) -> str:
    """> 95 % earns int(points), > 90 % earns int(points x 0.6), else 0."""
    r = _clamp_sql(rate)
    return (f"CAST(CASE WHEN {possible} <= 0 THEN 0 WHEN {r} > {_d(95)} THEN floor({possible}) "
            f"WHEN {r} > {_d(90)} THEN floor({possible} * {_d(0.6)}) ELSE 0 END AS DOUBLE)")


# A3
def points_tiered_sql(possible: str, rate: str, high: float = 95.0, mid: float = 90.0, factor: float = 0.6) -> str:
    """>= high earns all; >= mid earns round-half-even(points x factor) clamped to [0, int(points)]."""
    r = f"coalesce({rate}, {_d(0)})"
    mid_pts = f"greatest({_d(0)}, least(CAST(floor({possible}) AS DOUBLE), rint({possible} * {_d(factor)})))"
    return (f"CAST(CASE WHEN {possible} <= 0 THEN {_d(0)} WHEN {r} >= {_d(high)} THEN {possible} "
            f"WHEN {r} >= {_d(mid)} THEN {mid_pts} ELSE {_d(0)} END AS DOUBLE)")


# A4
def points_linear_sql(possible: str, rate: str) -> str:
    return (f"CAST(CASE WHEN {possible} <= 0 THEN {_d(0)} "
            f"ELSE {possible} * ({_clamp_sql(rate)} / {_d(100)}) END AS DOUBLE)")


# A2
def points_all_or_nothing_sql(possible: str, rate: str, full_at: float = 100.0) -> str:
    return f"CAST(CASE WHEN coalesce({rate}, {_d(0)}) >= {_d(full_at)} THEN {possible} ELSE {_d(0)} END AS DOUBLE)"


# A1
def points_threshold_sql(rate: str, thresholds: tuple[tuple[float, float], ...]) -> str:
    """Highest threshold first; the first one the rate reaches gives the points."""
    whens = " ".join(f"WHEN coalesce({rate}, {_d(0)}) >= {_d(t)} THEN {_d(p)}"
                     for t, p in sorted(thresholds, key=lambda x: -x[0]))
    return f"CAST(CASE {whens} ELSE {_d(0)} END AS DOUBLE)" if whens else _d(0)


def points_sql(spec: CheckSpec, policy: Policy, possible: str, rate: str) -> str:
    rule = policy.points_rule
    if rule == "strict":
        return points_strict_sql(possible, rate)
    if rule == "tiered":
        return points_tiered_sql(possible, rate, spec.high_pass_rate, spec.mid_pass_rate, spec.mid_points_factor)
    if rule == "linear":
        return points_linear_sql(possible, rate)
    if rule == "all_or_nothing":
        return points_all_or_nothing_sql(possible, rate, spec.full_at)
    if rule == "threshold":
        return points_threshold_sql(rate, spec.thresholds)
    raise ValueError(f"unknown points rule {rule!r}")


def points_for(spec: CheckSpec, policy: Policy, possible: str, rate: str) -> Column:
    """Points of a check as a Column over columns named ``possible`` and ``rate``."""
    return F.expr(points_sql(spec, policy, f"`{possible}`", f"`{rate}`"))


def pass_rate_sql(total: str, passed: str, empty_rate: float) -> str:
    return f"CASE WHEN ({total}) > 0 THEN ({passed}) / ({total}) * {_d(100)} ELSE {_d(empty_rate)} END"


# A9
def status_band(score: Column, bands: tuple[float, float, float, float] = (95.0, 85.0, 75.0, 65.0)) -> Column:
    # Status labels, best first.
    excellent, good, fair, poor = bands
    return (F.when(score >= excellent, "EXCELLENT").when(score >= good, "GOOD")
             .when(score >= fair, "FAIR").when(score >= poor, "POOR").otherwise("CRITICAL"))


# A12
def check_status(earned: Column, possible: Column) -> Column:
    return F.when(earned == possible, "PASS").when(earned > 0, "WARN").otherwise("FAIL")


def pass_rate(total: Column, passed: Column, empty_rate: Column) -> Column:
    """passed / total x 100, or the empty-scope rate when nothing is in scope."""
    return F.when(total > 0, passed / total * 100.0).otherwise(empty_rate).cast("double")


# A6
def category_scores(checks: DataFrame) -> DataFrame:
    """Earned, possible and percentage per category."""
    return (checks.groupBy("category")
            .agg(F.sum("points_earned").alias("points_earned"), F.sum("points_possible").alias("points_possible"))
            .withColumn("percentage", F.when(F.col("points_possible") > 0,
                                             F.col("points_earned") / F.col("points_possible") * 100.0)
                                       .otherwise(0.0)))


def _is_risk(c: Column) -> Column:
    return c.isin("risk_policy_match")


# A7 / A8 / A10 / A11 / A13
def score_aggs(policy: Policy) -> list[Column]:
    """Aggregates over check-result rows: overall score, summary counts, critical issues, risk flag.
    Rows without a check_id (other one-row inputs unioned in) are ignored."""
    pe, pp = F.col("points_earned"), F.col("points_possible")
    is_check = F.col("check_id").isNotNull()
    risk = _is_risk(F.col("check_type"))
    if policy.overall_rule == "sum":
        overall = F.coalesce(F.sum(pe), F.lit(0.0))
    else:
        earned = F.sum(F.when(~risk, pe))
        possible = F.sum(F.when(~risk, pp))
        overall = F.when(possible > 0, earned / possible * 100.0).otherwise(0.0)
    if policy.summary_rule == "v5":
        total = F.count_if(is_check)
        passed = F.count_if((pp > 0) & (pe == pp))
        failed = F.count_if((pp > 0) & (pe != pp) & (pe == 0))
        warn = F.count_if((pp > 0) & (pe != pp) & (pe != 0))
        critical = F.lit(0)
    elif policy.summary_rule == "root":
        total = F.count_if(is_check)
        passed = F.count_if(pe == pp)
        warn = F.count_if((pe != pp) & (pe > 0))
        failed = F.count_if((pe != pp) & ~(pe > 0))
        critical = F.count_if((pe != pp) & ~(pe > 0) & (F.col("priority") == "critical"))
    else:
        total = F.count_if(is_check & ~risk)
        passed = F.count_if(~risk & (pe == pp))
        failed = F.count_if(~risk & (pe == 0))
        warn = total - passed - failed
        critical = F.lit(0)
    risk_ok = F.coalesce(F.max(F.when(risk, F.col("pass_rate") == 100.0)), F.lit(False))
    return [overall.cast("double").alias("overall_score"),
            total.cast("long").alias("total_checks"), passed.cast("long").alias("passed_checks"),
            warn.cast("long").alias("warning_checks"), failed.cast("long").alias("failed_checks"),
            critical.cast("long").alias("critical_issues_count"), risk_ok.alias("risk_match_ok")]


# A9
def with_status(scores: DataFrame, policy: Policy) -> DataFrame:
    return scores.withColumn("status", status_band(F.col("overall_score"), policy.status_bands))


def run_score(checks: DataFrame, policy: Policy) -> DataFrame:
    """One row: overall score, status, summary counts, critical issues and the risk flag."""
    return with_status(checks.agg(*score_aggs(policy)), policy)


def category_aggs(categories) -> list[Column]:
    """Per-category percentage and earned points as fixed columns (a pivot with known values)."""
    out = []
    for cat in categories:
        key = cat.lower().replace("-", "_").replace(" ", "_")
        hit = F.col("category") == cat
        earned, possible = F.sum(F.when(hit, F.col("points_earned"))), F.sum(F.when(hit, F.col("points_possible")))
        pct = F.when(possible > 0, earned / possible * 100.0).when(possible.isNotNull(), 0.0)
        out.append(pct.cast("decimal(5,2)").alias(f"{key}_score"))
        out.append(earned.alias(f"{key}_points"))
    return out


def critical_issues(checks: DataFrame) -> DataFrame:
    """Checks that earned nothing and are marked critical."""
    pe, pp = F.col("points_earned"), F.col("points_possible")
    return checks.where((pe != pp) & ~(pe > 0) & (F.col("priority") == "critical")).select(
        "check_id", "check_name", F.col("failed").alias("failed_count"))
