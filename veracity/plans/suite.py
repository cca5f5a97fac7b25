"""Suite planner: turns a list of check specs into ONE Spark plan.

* every row check becomes two ``count_if`` aggregates of a single shared
  ``agg`` over the current snapshot (one scan, no shuffle but a one-row
  partial/final aggregate);
* the claim-keyed checks (uniqueness, missing claims, paid not decreasing)
  share ONE key profile: each snapshot is grouped once on the claim key and
  the two per-key aggregates are joined without a further exchange;
* every other key check is its own aggregation/join branch over only the
  columns it needs (column pruning reaches the parquet scan);
* skipped and absent-column checks are constant rows;
* all branches meet in a ``union`` of one-row results, and scoring runs as
  Column expressions over that small frame.

Nothing is collected to the driver: the caller decides whether to display,
write or checkpoint the results.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veracity.operators import keychecks as kc
from veracity.operators import rowchecks as rc
from veracity.plans import scoring
from veracity.plans.keystate import ArrivedKeys
from veracity.plans.spec import CheckSpec, Policy

KEY_TYPES = {"unique", "missing_claims_from_prev_month", "total_paid_non_decreasing_vs_prev",
             "risk_policy_match", "loss_ratio"}
PREV_TYPES = {"missing_claims_from_prev_month", "total_paid_non_decreasing_vs_prev"}
RISK_TYPES = {"risk_policy_match", "loss_ratio"}

# Context columns shown next to failing rows, per check type ('check_field' = the checked field).
CONTEXT_COLUMNS = {
    "not_null": ("claim_number", "check_field"),
    "not_null_not_year_1900": ("claim_number", "check_field"),
    "non_negative": ("claim_number", "check_field"),
    "unique": ("claim_number", "check_field"),
    "valid_date": ("claim_number", "check_field"),
    "closed_os_zero": ("claim_number", "claim_status", "total_os"),
    "loss_within_policy": ("claim_number", "accident_date", "policy_start_date", "policy_end_date"),
    "incurred_equals_paid_plus_os": ("claim_number", "total_incurred", "total_paid", "total_os"),
}

RESULT_COLUMNS = ["seq", "check_id", "check_name", "check_type", "category", "subcategory", "priority", "field",
                  "points_possible", "total", "passed", "failed", "pass_rate", "points_earned", "skipped", "error",
                  "status"]


def row_check(spec: CheckSpec, policy: Policy, cols: rc.Cols, closed_values: Sequence[str],
              as_of_year: int) -> rc.RowCheck | None:
    t = spec.type
    if t == "not_null":
        return rc.not_null(cols, spec.field, policy.blank_is_null)
    if t == "not_null_not_year_1900":
        return rc.not_null_not_year_1900(cols, spec.field)
    if t == "non_negative":
        return rc.non_negative(cols, spec.field, policy.non_negative_null)
    if t == "non_negative_all":
        return rc.non_negative_all(cols, spec.fields)
    if t == "valid_date":
        return rc.valid_date(cols, spec.field, policy.valid_date_null)
    if t == "valid_dates_all":
        return rc.valid_dates_all(cols, spec.fields)
    if t == "year_in_range":
        return rc.year_in_range(cols, spec.field, spec.as_of_year or as_of_year)
    if t == "closed_os_zero":
        status, os_ = spec.fields or ("claim_status", "total_os")
        return rc.closed_os_zero(cols, status, os_, spec.closed_values or closed_values, policy.closed_match, policy.closed_os_null)
    if t == "loss_within_policy":
        return rc.loss_within_policy(cols, *(spec.fields or ()), rule=policy.loss_rule)
    if t == "incurred_equals_paid_plus_os":
        tot, a, b = spec.fields or ("total_incurred", "total_paid", "total_os")
        return rc.sum_within_tolerance(cols, tot, a, b, spec.tolerance or 0.0, policy.formula_empty_rate)
    if t == "gross_formula":
        tot, a, b = spec.fields or ("gross_incurred", "gross_paid", "gross_estimate")
        return rc.sum_within_tolerance(cols, tot, a, b, 1.0 if spec.tolerance is None else spec.tolerance)
    if t == "net_within_gross":
        return rc.net_within_gross(cols, *(spec.fields or ()))
    if t == "date_sequence":
        return rc.date_not_after(cols, *(spec.fields or ("accident_date", "notification_date")))
    if t == "year_matches_date":
        return rc.year_matches_date(cols, *(spec.fields or ("accident_year", "accident_date")))
    if t == "expression":
        if (gone := cols.absent(*spec.fields)):
            return rc.RowCheck(F.lit(True), F.lit(False), missing=gone)
        scope = spec.scope or (" and ".join(f"`{f}` is not null" for f in spec.fields) or None)
        return rc.expression(cols, spec.predicate, scope, spec.empty_rate, spec.value_kind)
    if t == "range":
        lo, hi = spec.bounds
        if spec.fields:
            return rc.values_in_range_all(cols, spec.fields, lo, hi)
        return rc.value_range(cols, spec.field, lo, hi)
    return None


def planned_row_check(spec: CheckSpec, policy: Policy, cols: rc.Cols, closed_values: Sequence[str],
                      as_of_year: int) -> rc.RowCheck | None:
    """``row_check`` on its own: what can't be built or resolved becomes an error row, and the run
    goes on. Only declared expressions and columns of unexpected types need the analyser's word."""
    try:
        if spec.type in ROW_TYPES and spec.type in FIELD_TYPES and not spec.field:
            raise ValueError(f"check {spec.id} names no field")
        chk = row_check(spec, policy, cols, closed_values, as_of_year)
        if chk is not None and not chk.missing and spec.type in ("expression", "range"):
            types = cols.df.select(chk.scope.alias("s"), chk.ok.alias("o")).schema
            if any(f.dataType.simpleString() != "boolean" for f in types):
                raise ValueError(f"check {spec.id} isn't a condition")
        return chk
    except (AnalysisException, ParseException, TypeError, ValueError, KeyError) as e:
        return rc.RowCheck(F.lit(False), F.lit(False), error=" ".join(str(e).split())[:200] or type(e).__name__)


FIELD_TYPES = {"not_null", "not_null_not_year_1900", "non_negative", "valid_date", "year_in_range"}


def _q(text: str | None) -> str:
    """A SQL string literal (or NULL)."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _result_sql(spec: CheckSpec, seq: int, policy: Policy, total: str, passed: str, failed: str, rate: str,
                skipped: bool = False, error: str | None = None, earned: str | None = None) -> str:
    """One result row as a ``named_struct`` in SQL text: the JVM parses a whole suite's rows in one
    ``selectExpr`` instead of Python building each expression through the gateway."""
    possible = f"CAST({float(spec.points)!r} AS DOUBLE)"
    rate = f"CAST({rate} AS DOUBLE)"
    if earned is None:
        earned = scoring.points_sql(spec, policy, possible, rate)
    fields = [("seq", str(seq)), ("check_id", _q(spec.id)), ("check_name", _q(spec.name)),
              ("check_type", _q(spec.type)), ("category", _q(spec.category)),
              ("subcategory", _q(spec.subcategory)), ("priority", _q(spec.priority)),
              ("field", _q(spec.field or ",".join(spec.fields))), ("points_possible", possible),
              ("total", f"CAST({total} AS BIGINT)"), ("passed", f"CAST({passed} AS BIGINT)"),
              ("failed", f"CAST({failed} AS BIGINT)"), ("pass_rate", rate),
              ("points_earned", f"CAST({earned} AS DOUBLE)"), ("skipped", "true" if skipped else "false"),
              ("error", _q(error))]
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"


def _rows(df: DataFrame, structs: list[str]) -> DataFrame:
    return df.selectExpr(f"inline(array({', '.join(structs)}))")


@dataclass
class SuiteRun:
    """A planned suite run. ``checks`` is one row per enabled check in suite order."""

    checks: DataFrame
    policy: Policy
    specs: list[CheckSpec]
    current: DataFrame
    previous: DataFrame | None
    risk: DataFrame | None
    row_checks: dict[str, rc.RowCheck]
    fused: DataFrame | None = None
    keys: ArrivedKeys | None = None
    listed: DataFrame | None = None
    key_parts: int | None = None

    def total_records(self) -> DataFrame:
        """One row ``n``: the current snapshot's row count, from the fused row-check aggregate."""
        if self.fused is not None:
            return self.fused.select("n")
        return self.current.agg(F.count(F.lit(1)).alias("n"))

    def categories(self) -> DataFrame:
        return scoring.category_scores(self.checks)

    def score(self) -> DataFrame:
        return scoring.run_score(self.checks, self.policy)

    def materialize(self, listed: DataFrame | None = None) -> SuiteRun:
        """Cut the lineage of the (small) results with a reliable checkpoint in the shared
        checkpoint folder, so several reports reuse one evaluation of the scans. ``listed``: the run's
        (check_id, failed_records_json), evaluated in one plan with the checks and kept as ``self.listed``."""
        from veracity.session import checkpoint_dir
        checkpoint_dir(self.checks.sparkSession)
        if listed is None:
            self.checks = self.checks.checkpoint(eager=True)
        else:
            both = self.checks.join(listed, "check_id", "left").checkpoint(eager=True)
            self.checks = both.select(*self.checks.columns)
            self.listed = both.where(F.col("failed_records_json").isNotNull()).select(*listed.columns).dropDuplicates(["check_id"])
        self.fused = self.total_records().checkpoint(eager=True)
        return self

    def context_columns(self, spec: CheckSpec) -> list[str]:
        """The columns shown with a row check's failing rows."""
        ctx = [c if c != "check_field" else spec.field for c in CONTEXT_COLUMNS.get(spec.type, ())]
        return [c for c in dict.fromkeys(ctx) if c and c in self.current.columns] or self.current.columns

    def failing(self, check_id: str) -> DataFrame:
        """Failing rows (row checks, with context columns) or failing keys (key checks)."""
        spec = next(s for s in self.specs if s.id == check_id and s.enabled)
        if spec.id in self.row_checks:
            check, ctx = self.row_checks[check_id], self.context_columns(spec)
            if check.missing or check.error:
                return self.current.select(*ctx).where(F.lit(False))   # nothing was checked: no failing rows
            return self.current.where(check.scope & ~F.coalesce(check.ok, F.lit(False))).select(*ctx)
        keys = self.failing_keys(spec)
        if keys is None:
            raise KeyError(f"check {check_id} ({spec.type}) didn't run")
        return keys

    def claim_key_role(self, spec: CheckSpec) -> str | None:
        """'u', 'm' or 'p' where the failing claim numbers of a key check (J1, J3, J4) can be read off the groupings of
        the key profile; None where they can't."""
        t, cur, prev = spec.type, self.current, self.previous
        if self.keys is not None or CLAIM_KEY not in cur.columns:
            return None
        if t == "unique":
            text = cur.schema[CLAIM_KEY].dataType.simpleString() == "string"
            return "u" if (spec.field or CLAIM_KEY) == CLAIM_KEY and text else None
        if t not in PREV_TYPES or prev is None or (spec.key or CLAIM_KEY, spec.paid or PAID) != (CLAIM_KEY, PAID) or CLAIM_KEY not in prev.columns:
            return None
        if t == "missing_claims_from_prev_month":
            return "m"
        return "p" if self.policy.paid_rule == "left" and PAID in cur.columns and PAID in prev.columns else None

    def failing_keys(self, spec: CheckSpec) -> DataFrame | None:
        """Failing keys or rows of a key check; None where it didn't run (an input or column is absent,
        or the type is unknown)."""
        t, cur, prev, risk = spec.type, self.current, self.previous, self.risk
        claim, paid = spec.key or CLAIM_KEY, spec.paid or PAID
        if t == "unique":
            key = spec.field or CLAIM_KEY
            if key not in cur.columns:
                return None
            ctx = [c for c in dict.fromkeys([CLAIM_KEY, key]) if c in cur.columns]
            return kc.failing_duplicates(cur, key).select(*ctx)
        if t in PREV_TYPES and self.keys is not None and self.keys.previous is not None \
                and (claim, paid) == (self.keys.key, self.keys.paid) and self.policy.paid_rule == "left":
            return self.keys.missing() if t == "missing_claims_from_prev_month" else self.keys.decreased()
        if t in PREV_TYPES:
            needed = [claim] if t == "missing_claims_from_prev_month" else [claim, paid]
            if prev is None or any(c not in cur.columns or c not in prev.columns for c in needed):
                return None
            if t == "missing_claims_from_prev_month":
                return kc.failing_missing_keys(cur, prev, claim)
            if self.policy.paid_rule == "left":
                return kc.failing_paid_keys(cur, prev, claim, paid).select(claim)
            return kc.failing_paid_rows(cur, prev, claim, paid).select(claim, paid)
        if t == "risk_policy_match" and risk is not None:
            ref = kc.resolve_risk_key(risk, spec.risk_key or "risk_policy_number", self.policy.risk_key_fallback)
            key = spec.key or "policy_number"
            return kc.failing_reference_keys(cur, risk, key, ref) if ref is not None and key in cur.columns else None
        if t == "loss_ratio" and risk is not None:
            if any(c not in cur.columns for c in ("policy_number", "gross_incurred")) or \
                    any(c not in risk.columns for c in ("risk_policy_number", "gwp")):
                return None
            return kc.loss_ratio_table(cur, risk).where(~F.col("ok"))
        return None


ROW_TYPES = {"not_null", "not_null_not_year_1900", "non_negative", "non_negative_all", "valid_date",
             "valid_dates_all", "year_in_range", "closed_os_zero", "loss_within_policy",
             "incurred_equals_paid_plus_os", "gross_formula", "net_within_gross", "date_sequence",
             "year_matches_date", "expression", "range"}


def _key_result(spec: CheckSpec, policy: Policy, current: DataFrame, previous: DataFrame | None,
                risk: DataFrame | None, n_rows: DataFrame, key_parts: int | None = None) -> tuple[DataFrame, float, str | None]:
    """One-row (total, passed, failed) frame for a key check, its empty-scope rate and an error text."""
    t = spec.type
    spark = current.sparkSession
    zero = kc.constant_result(spark, 0, 0, 0)
    if t == "unique":
        key = spec.field or "claim_number"
        if key not in current.columns:
            return n_rows.select(F.col("n").alias("total"), F.lit(0).alias("passed"), F.lit(0).alias("failed")), \
                0.0, f"column not found: {key}"
        return kc.uniqueness(current, key, policy.unique_keep), 0.0, None
    if t == "missing_claims_from_prev_month":
        key = spec.key or CLAIM_KEY
        if key not in current.columns or key not in previous.columns:
            return zero, 0.0, f"column not found: {key}"
        return kc.missing_keys(current, previous, key), policy.empty_key_rate, None
    if t == "total_paid_non_decreasing_vs_prev":
        key, paid = spec.key or CLAIM_KEY, spec.paid or PAID
        for c in (key, paid):
            if c not in current.columns or c not in previous.columns:
                return zero, 0.0, f"column not found: {c}"
        if policy.paid_rule == "rows":
            return kc.paid_not_decreasing_rows(current, previous, key, paid, parts=key_parts), policy.paid_empty_rate, None
        return kc.paid_not_decreasing(current, previous, key, paid), policy.paid_empty_rate, None
    if t == "risk_policy_match":
        key = spec.key or "policy_number"
        if key not in current.columns:
            return zero, 0.0, f"column not found: {key}"
        ref = kc.resolve_risk_key(risk, spec.risk_key or "risk_policy_number", policy.risk_key_fallback)
        if ref is None and not policy.risk_key_fallback:
            return zero, 0.0, "reference key column not found"
        if ref is None:
            return n_rows.select(F.col("n").alias("total"), F.lit(0).alias("passed"), F.col("n").alias("failed")), \
                0.0, "reference key column not found"
        return kc.keys_in_reference(current, risk, key, ref), policy.empty_key_rate, None
    if t == "loss_ratio":
        needed = [c for c in ("policy_number", "gross_incurred") if c not in current.columns]
        needed += [c for c in ("risk_policy_number", "gwp") if c not in risk.columns]
        if needed:
            return zero, 0.0, f"column not found: {', '.join(needed)}"
        return kc.loss_ratio(current, risk), 0.0, None
    raise ValueError(t)


def run_suite(specs: Sequence[CheckSpec], policy: Policy, current: DataFrame, previous: DataFrame | None = None,
              risk: DataFrame | None = None, closed_values: Sequence[str] | None = None,
              as_of_year: int | None = None, keys: ArrivedKeys | Callable[[DataFrame], ArrivedKeys] | None = None,
              store_to: str | None = None, key_parts: int | None = None) -> SuiteRun:
    """Plan a suite over a mapped current snapshot (and optional previous snapshot / reference table).
    ``keys``: the snapshot's key state and the previous one's, which serve the claim-keyed checks instead of the
    claims; the previous snapshot itself is then only needed by checks on other keys or on pairs of rows. Or a
    function that gives them of the current snapshot, once that is stored.
    ``store_to``: the current snapshot is written there as Parquet (a new folder) and the row checks are counted by that
    very write; everything else reads the stored snapshot.
    ``key_parts``: partitions for the groupings of claim keys, where the session's shuffle partitions are fewer."""
    spark = current.sparkSession
    closed_values = list(closed_values or policy.closed_values)
    as_of_year = as_of_year or policy.as_of_year or _dt.date.today().year
    cols = rc.Cols(current, coerce=policy.coerce)
    enabled = [s for s in specs if s.enabled]

    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    row_slots: dict[int, tuple[CheckSpec, rc.RowCheck]] = {}
    planned: list[tuple[int, CheckSpec]] = []
    for seq, spec in enumerate(enabled):
        if spec.type in RISK_TYPES and risk is None and (policy.omit_risk_without_table or spec.type == "loss_ratio"):
            continue
        planned.append((seq, spec))
        chk = planned_row_check(spec, policy, cols, closed_values, as_of_year)
        if chk is None:
            continue
        row_slots[seq] = (spec, chk)
        if chk.error:
            continue
        if chk.missing:
            if chk.missing_scope is not None:
                aggs.append(F.count_if(chk.missing_scope).alias(f"t{seq}"))
        else:
            aggs.append(F.count_if(chk.scope).alias(f"t{seq}"))
            aggs.append(F.count_if(chk.scope & F.coalesce(chk.ok, F.lit(False))).alias(f"p{seq}"))

    if store_to is None:
        fused = current.agg(*aggs)
    else:
        fused = _observed_write(current, aggs, store_to)
        current = spark.read.schema(current.schema).parquet(store_to)
    if callable(keys):
        keys = keys(current)
    n_rows = fused.select("n")
    parts: list[DataFrame] = []

    structs = []
    for seq, (spec, chk) in row_slots.items():
        if chk.error:
            structs.append(_result_sql(spec, seq, policy, "0", "0", "0", "0", error=chk.error, earned="0"))
            continue
        if chk.missing:
            total = f"t{seq}" if chk.missing_scope is not None else "n"
            structs.append(_result_sql(spec, seq, policy, total, "0", "0", "0", error=f"column not found: {chk.missing}"))
            continue
        total, passed = f"t{seq}", f"p{seq}"
        rate = scoring.pass_rate_sql(total, passed, chk.empty_rate)
        structs.append(_result_sql(spec, seq, policy, total, passed, f"{total} - {passed}", rate))
    if structs:
        parts.append(_rows(fused, structs))

    profiled = _profile_part(planned, row_slots, policy, current, previous, keys, key_parts)
    if profiled is not None:
        part, done = profiled
        parts.append(part)
    else:
        done = set()

    for seq, spec in planned:
        if seq in row_slots or seq in done:
            continue
        if spec.type not in KEY_TYPES:
            parts.append(_rows(spark.range(1), [_result_sql(spec, seq, policy, "0", "0", "0", "0",
                                                            error=f"Unknown check type: {spec.type}", earned="0")]))
            continue
        needs_prev = spec.type in PREV_TYPES and previous is None
        needs_risk = spec.type in RISK_TYPES and risk is None
        if needs_prev or needs_risk:
            parts.append(_skipped(spark, spec, seq, policy, "previous snapshot" if needs_prev else "reference table"))
            continue
        res, empty_rate, error = _key_result(spec, policy, current, previous, risk, n_rows, key_parts)
        rate = "0" if error else scoring.pass_rate_sql("total", "passed", empty_rate)
        parts.append(_rows(res, [_result_sql(spec, seq, policy, "total", "passed", "failed", rate, error=error)]))

    checks = reduce(DataFrame.unionByName, parts)
    checks = checks.withColumn("status", scoring.check_status(F.col("points_earned"), F.col("points_possible")))
    return SuiteRun(checks.select(*RESULT_COLUMNS), policy, list(specs), current, previous, risk,
                    {spec.id: chk for spec, chk in row_slots.values()}, fused, keys, key_parts=key_parts)


def _observed_write(df: DataFrame, aggs: list[Column], path: str) -> DataFrame:
    """Writes ``df`` and returns, as one row, the counts that the write observed on the way."""
    seen = Observation()
    df.observe(seen, *aggs).write.option("compression", "zstd").parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    return df.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


CLAIM_KEY, PAID = "claim_number", "total_paid"


def _profile_part(planned, row_slots, policy: Policy, current: DataFrame, previous: DataFrame | None,
                  arrived: ArrivedKeys | None = None, key_parts: int | None = None) -> tuple[DataFrame, set[int]] | None:
    """Serve the claim-keyed checks (unique, missing, paid) from one key profile: one grouping
    per snapshot on the claim key instead of one shuffle per check, or the stored key states."""
    if CLAIM_KEY not in current.columns:
        return None
    if arrived is not None and (arrived.key, arrived.paid) != (CLAIM_KEY, PAID):
        arrived = None
    has_prev_key = previous is not None and CLAIM_KEY in previous.columns if arrived is None else arrived.previous is not None
    has_paid = has_prev_key and PAID in current.columns and (arrived is not None or PAID in previous.columns)
    roles: dict[int, tuple[str, CheckSpec]] = {}
    for seq, spec in planned:
        if seq in row_slots:
            continue
        if spec.type == "unique" and (spec.field or CLAIM_KEY) == CLAIM_KEY:
            roles[seq] = ("u", spec)
        elif (spec.key or CLAIM_KEY) != CLAIM_KEY or (spec.paid or PAID) != PAID:
            continue
        elif spec.type == "missing_claims_from_prev_month" and has_prev_key:
            roles[seq] = ("m", spec)
        elif spec.type == "total_paid_non_decreasing_vs_prev" and has_paid and policy.paid_rule == "left":
            roles[seq] = ("p", spec)
    if not roles:
        return None
    kinds = {r for r, _ in roles.values()}
    prof = arrived.profile() if arrived is not None else kc.key_profile(current, previous if kinds & {"m", "p"} else None, CLAIM_KEY,
                          PAID if "p" in kinds else None, policy.unique_keep, key_parts)
    structs = []
    for seq, (role, spec) in roles.items():
        if role == "u":
            total = "coalesce(u_total, 0)"
            passed = f"{total} - coalesce(u_failed, 0)" if policy.unique_keep == "none" else "coalesce(u_groups, 0)"
            empty = 0.0
        elif role == "m":
            total, passed, empty = "coalesce(m_total, 0)", "coalesce(m_passed, 0)", policy.empty_key_rate
        else:
            total, passed, empty = "coalesce(p_total, 0)", "coalesce(p_passed, 0)", policy.paid_empty_rate
        rate = scoring.pass_rate_sql(total, passed, empty)
        structs.append(_result_sql(spec, seq, policy, total, passed, f"{total} - ({passed})", rate))
    return _rows(prof, structs), set(roles)


def _skipped(spark, spec: CheckSpec, seq: int, policy: Policy, what: str) -> DataFrame:
    """A check that cannot run: full points (rate 100), zero points (rate 0) or a warning row."""
    if policy.skip_rule == "full":
        r = _result_sql(spec, seq, policy, "0", "0", "0", "100", skipped=True, earned=repr(float(spec.points)))
    elif policy.skip_rule == "zero":
        r = _result_sql(spec, seq, policy, "0", "0", "0", "0", skipped=True)
    else:
        r = _result_sql(spec, seq, policy, "0", "0", "0", "0", skipped=True, error=f"{what} not available",
                        earned="0")
    return _rows(spark.range(1), [r])
