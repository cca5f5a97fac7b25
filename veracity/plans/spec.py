"""Check specifications, scoring policies and the built-in suites.

A suite is a plain list of ``CheckSpec``; a ``Policy`` is a named bundle of the
semantic choices on which the validator generations differ (null handling,
closed-status matching, loss-period rule, points rule, skip rule, overall rule).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CheckSpec:
    id: str
    name: str
    type: str
    category: str
    subcategory: str
    points: float
    field: str | None = None
    fields: tuple[str, ...] = ()
    enabled: bool = True
    tolerance: float | None = None
    priority: str = "medium"
    thresholds: tuple[tuple[float, float], ...] = ()   # 'threshold' points rule: (rate >=, points)
    full_at: float = 100.0                             # 'all_or_nothing' points rule
    high_pass_rate: float = 95.0                       # 'tiered' points rule
    mid_pass_rate: float = 90.0
    mid_points_factor: float = 0.6
    predicate: str | None = None                       # 'expression' checks
    scope: str | None = None
    risk_key: str | None = None
    as_of_year: int | None = None
    bounds: tuple[float | None, float | None] = (None, None)   # 'range' checks
    empty_rate: float = 0.0                                      # 'expression' checks with an empty scope
    value_kind: str | None = None            # 'expression' checks: read columns as 'number' or 'date'
    key: str | None = None                   # key checks: the claim or policy column, where not the default
    paid: str | None = None                  # paid-not-decreasing: the paid column
    closed_values: tuple[str, ...] | None = None   # closed-status checks: their own values


@dataclass(frozen=True)
class Policy:
    name: str
    coerce: str = "all"                      # all | dates_numbers (text stays as it is) | none
    blank_is_null: bool = True
    non_negative_null: str = "fail"          # fail | pass | drop
    valid_date_null: str = "fail"            # fail | pass
    closed_match: str = "word"               # word | substring | exact | case_sensitive
    closed_os_null: str = "fail"             # fail | pass
    loss_rule: str = "v5"                    # v5 | row_fallback | no_fallback | drop_empty_full
    formula_empty_rate: float = 0.0
    unique_keep: str = "none"                # none | first
    paid_rule: str = "left"                  # left | rows
    empty_key_rate: float = 100.0            # J3/J6 with no keys
    risk_key_fallback: bool = True           # try other key names; without any, every row fails
    paid_empty_rate: float = 0.0
    points_rule: str = "strict"              # strict | tiered | linear | all_or_nothing | threshold
    skip_rule: str = "full"                  # full | zero | warn
    omit_risk_without_table: bool = False
    overall_rule: str = "sum"                # sum | percent_ex_risk
    summary_rule: str = "v5"                 # v5 | root | v2
    status_bands: tuple[float, float, float, float] = (95.0, 85.0, 75.0, 65.0)
    closed_values: tuple[str, ...] = ("Closed",)
    as_of_year: int | None = None


# ---- the profiles -----------------------------------------------------------------------------

V5 = Policy("v5")
V4 = replace(V5, name="v4", blank_is_null=False, non_negative_null="pass", valid_date_null="pass",
             closed_match="substring", closed_os_null="pass", loss_rule="row_fallback", skip_rule="zero",
             risk_key_fallback=False)
V0 = replace(V4, name="v0")
V3 = replace(V4, name="v3", closed_match="exact", points_rule="linear")
V1 = replace(V3, name="v1", loss_rule="no_fallback", points_rule="tiered")
V2 = Policy("v2", coerce="dates_numbers", blank_is_null=False, non_negative_null="drop", valid_date_null="fail",
            closed_match="case_sensitive", closed_os_null="fail", loss_rule="drop_empty_full",
            formula_empty_rate=100.0, unique_keep="first", paid_rule="rows", paid_empty_rate=100.0,
            points_rule="all_or_nothing", skip_rule="warn", omit_risk_without_table=True,
            overall_rule="percent_ex_risk", summary_rule="v2")
ROOT = Policy("root", coerce="none", blank_is_null=False, points_rule="threshold", summary_rule="root",
              formula_empty_rate=0.0)

POLICIES = {p.name: p for p in (V0, V1, V2, V3, V4, V5, ROOT)}


def default_suite(include_risk: bool = False) -> list[CheckSpec]:
    """The canonical monthly claims suite: 16 enabled checks worth 100 points, risk check optional."""
    # Ids, names, categories and points of the canonical suite.
    nn, neg, lg = ("Not Null", "Core"), ("Non-Negative", "Financial"), ("Logical", "Rules")
    specs = [
        CheckSpec("1.1", "Policy Number Not Null", "not_null", *nn, 5, field="policy_number"),
        CheckSpec("1.2", "Claim Number Not Null", "not_null", *nn, 5, field="claim_number"),
        CheckSpec("1.3", "Accident Date / Date of Loss Not Null", "not_null", *nn, 5, field="accident_date"),
        CheckSpec("1.4", "Status of Claim Not Null", "not_null", *nn, 5, field="claim_status"),
        CheckSpec("1.5", "UW Date Not Null and Not Year 1900", "not_null_not_year_1900", *nn, 5, field="uw_date"),
        CheckSpec("2.1", "Total Incurred Non-Negative", "non_negative", *neg, 7, field="total_incurred"),
        CheckSpec("2.2", "Total Paid Non-Negative", "non_negative", *neg, 7, field="total_paid"),
        CheckSpec("2.3", "Total OS Non-Negative", "non_negative", *neg, 7, field="total_os"),
        CheckSpec("3.1", "Closed Claim => Total OS = 0", "closed_os_zero", *lg, 10),
        CheckSpec("3.2", "Date of Loss within Policy Start/End", "loss_within_policy", *lg, 10),
        CheckSpec("3.3", "Total Incurred = Total Paid + Total OS", "incurred_equals_paid_plus_os", *lg, 10,
                  tolerance=5),
        CheckSpec("4.1", "Claim Number Unique", "unique", "Uniqueness", "Keys", 8, field="claim_number"),
        CheckSpec("5.1", "Accident Date Valid Format", "valid_date", "Valid Date", "Dates", 4, field="accident_date"),
        CheckSpec("5.2", "UW Date Valid Format", "valid_date", "Valid Date", "Dates", 4, field="uw_date"),
        CheckSpec("6.1", "Missing Claims vs Previous BDX Month", "missing_claims_from_prev_month",
                  "Continuity", "Month over Month", 4),
        CheckSpec("7.1", "Total Paid Non-Decreasing vs Previous BDX Month", "total_paid_non_decreasing_vs_prev",
                  "Continuity", "Month over Month", 4),
        CheckSpec("8.1", "Claims Policy Numbers exist in Risk Table", "risk_policy_match", "Risk", "Cross Table",
                  10, enabled=include_risk),
    ]
    return specs


def suite_v2() -> list[CheckSpec]:
    """The 14-check all-or-nothing suite plus the optional zero-point risk check."""
    # Ids, names and points of that suite.
    c, f, lg = ("Not Null", "Core"), ("Non-Negative", "Financial"), ("Logical", "Rules")
    mom = ("Historical", "Month over Month")
    return [
        CheckSpec("1.1", "Policy Number Complete", "not_null", *c, 7, field="policy_number"),
        CheckSpec("1.2", "Claim Number Complete", "not_null", *c, 7, field="claim_number"),
        CheckSpec("1.3", "Accident Date Complete", "not_null", *c, 7, field="accident_date"),
        CheckSpec("1.4", "Status of Claim Complete", "not_null", *c, 7, field="claim_status"),
        CheckSpec("1.5", "UW Date Valid", "not_null_not_year_1900", *c, 7, field="uw_date"),
        CheckSpec("2.1", "Total Incurred Non-Negative", "non_negative", *f, 7, field="total_incurred"),
        CheckSpec("2.2", "Total Paid Non-Negative", "non_negative", *f, 7, field="total_paid"),
        CheckSpec("2.3", "Total Reserve Non-Negative", "non_negative", *f, 7, field="total_os"),
        CheckSpec("3.1", "Closed Claims Zero Reserve", "closed_os_zero", *lg, 7),
        CheckSpec("3.2", "Loss Date Within Policy Period", "loss_within_policy", *lg, 7),
        CheckSpec("3.3", "Total Incurred = Reserve + Paid", "incurred_equals_paid_plus_os", *lg, 7,
                  tolerance=1, full_at=98.0),
        CheckSpec("4.1", "Claim Numbers Unique", "unique", "Uniqueness", "Keys", 7, field="claim_number"),
        CheckSpec("5.1", "No Missing Claims", "missing_claims_from_prev_month", *mom, 8),
        CheckSpec("5.2", "Total Paid Non-Decreasing", "total_paid_non_decreasing_vs_prev", *mom, 8, full_at=98.0),
        CheckSpec("6.1", "Risk Table Reconciliation", "risk_policy_match", "Risk", "Cross Table", 0),
    ]


def suite_root(as_of_year: int) -> list[CheckSpec]:
    """The 10 fixed gross/net checks plus the loss-ratio reconciliation (run only with a reference table)."""
    # Ids, names, priorities, points and pass-rate thresholds of that suite.
    return [
        CheckSpec("1.1", "Policy Number Complete", "not_null", "completeness", "critical_fields", 3,
                  field="policy_number", priority="critical", thresholds=((100, 3),)),
        CheckSpec("1.2", "Claim Number Complete", "not_null", "completeness", "critical_fields", 3,
                  field="claim_number", priority="critical", thresholds=((100, 3),)),
        CheckSpec("2.1", "Gross Incurred Formula", "gross_formula", "consistency", "financial", 3,
                  priority="critical", tolerance=1, thresholds=((98, 3), (95, 2), (90, 1))),
        CheckSpec("2.3", "Net <= Gross Relationship", "net_within_gross", "consistency", "financial", 3,
                  priority="critical", thresholds=((99, 3), (97, 2), (95, 1))),
        CheckSpec("3.1", "Non-Negative Financial Values", "non_negative_all", "reasonableness", "value_ranges", 3,
                  fields=("gross_paid", "gross_incurred", "net_paid", "net_incurred"), priority="critical",
                  thresholds=((99.5, 3), (99, 2), (98, 1))),
        CheckSpec("3.2", "Accident Year Reasonable Range", "year_in_range", "reasonableness", "value_ranges", 2,
                  field="accident_year", priority="high", thresholds=((99.9, 2), (99, 1)), as_of_year=as_of_year),
        CheckSpec("4.1", "Unique Claim Numbers", "unique", "data_quality", "duplicates", 3, field="claim_number",
                  priority="critical", thresholds=((100, 3), (99, 2), (97, 1))),
        CheckSpec("4.3", "Valid Date Formats", "valid_dates_all", "data_quality", "format", 2,
                  fields=("accident_date", "notification_date"), priority="high", thresholds=((100, 2), (99, 1))),
        CheckSpec("5.2", "Accident Before Notification", "date_sequence", "temporal_logic", "date_sequence", 3,
                  fields=("accident_date", "notification_date"), priority="critical",
                  thresholds=((98, 3), (95, 2), (92, 1))),
        CheckSpec("5.6", "Accident Year Matches Date", "year_matches_date", "temporal_logic", "date_sequence", 2,
                  fields=("accident_year", "accident_date"), priority="high", thresholds=((99.9, 2), (99, 1))),
        CheckSpec("11.1", "Total Incurred vs GWP Reconciliation", "loss_ratio", "consistency", "financial", 3,
                  priority="high", thresholds=((95, 3), (90, 2), (85, 1))),
    ]


# Result-table category columns per profile family.
SCORE_CATEGORIES_V5 = ("Not Null", "Non-Negative", "Logical", "Uniqueness", "Valid Date", "Continuity", "Risk")
SCORE_CATEGORIES_ROOT = ("completeness", "consistency", "reasonableness", "data_quality", "temporal_logic")

__all__ = ["CheckSpec", "Policy", "POLICIES", "default_suite", "suite_v2", "suite_root",
           "SCORE_CATEGORIES_V5", "SCORE_CATEGORIES_ROOT"]


# which checks cannot run with the columns and inputs at hand, and why.
_CHECK_FIELDS = {
    "closed_os_zero": ("claim_status", "total_os"),
    "loss_within_policy": ("accident_date", "policy_start_date"),        # end date falls back to start + 1 year
    "incurred_equals_paid_plus_os": ("total_incurred", "total_paid", "total_os"),
    "missing_claims_from_prev_month": ("claim_number",),
    "total_paid_non_decreasing_vs_prev": ("claim_number", "total_paid"),
    "risk_policy_match": ("policy_number", "risk_policy_number"),
}
_FIELD_TYPES = {"not_null", "not_null_not_year_1900", "non_negative", "unique", "valid_date"}


# The reasons shown for disabled checks.
REASON_NO_PREVIOUS = "Previous bdx month not available (MoM comparisons skipped)"
REASON_NO_REFERENCE = "Risk database not selected"
REASON_COLUMNS = "Missing/unmapped columns: "


def auto_disable(specs: list[CheckSpec], mapped: set[str], previous_available: bool,
                 reference_available: bool) -> tuple[list[CheckSpec], dict[str, str]]:
    """Disable checks whose inputs are missing; returns the new suite and {check_id: reason}."""
    out, reasons = [], {}
    for s in specs:
        reason = None
        if s.type in ("missing_claims_from_prev_month", "total_paid_non_decreasing_vs_prev") and not previous_available:
            reason = REASON_NO_PREVIOUS
        elif s.type == "risk_policy_match" and not reference_available:
            reason = REASON_NO_REFERENCE
        else:
            need = (s.field,) if s.type in _FIELD_TYPES and s.field else _CHECK_FIELDS.get(s.type, ())
            missing = [f for f in need if f not in mapped]
            if missing:
                reason = REASON_COLUMNS + ", ".join(missing)
        if reason and s.enabled:
            reasons[s.id] = reason
            s = replace(s, enabled=False)
        out.append(s)
    return out, reasons


def disabled_checks(spark: SparkSession, reasons: dict[str, str]) -> DataFrame:
    """The reasons of ``auto_disable`` as rows (check_id, reason)."""
    return spark.createDataFrame(sorted(reasons.items()), "check_id string, reason string")
