"""Validate every snapshot of a history table in one job.

Running the suite month by month costs one plan (and two snapshot scans) per
month. Here the whole history is read once:

* row checks: one aggregate grouped by the snapshot column;
* claim-keyed checks: one grouping on (snapshot, claim key); each snapshot's
  previous snapshot is the next lower distinct value, and the per-key rows of
  that previous snapshot are re-labelled to the following snapshot through the
  small snapshot -> previous mapping (one row per snapshot), then joined on
  (snapshot, key) — deduplicated keys on both sides, so no key can multiply;
* the reference-table check: distinct (snapshot, key) against distinct
  reference keys.

Every per-snapshot table has one row per snapshot, so assembling the results
joins only tables of that size. The first snapshot has no previous one and
follows the policy's skip rule.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.operators import keychecks as kc
from veracity.operators import rowchecks as rc
from veracity.plans import scoring
from veracity.plans.spec import CheckSpec, Policy
from veracity.plans.suite import CLAIM_KEY, KEY_TYPES, PAID, RESULT_COLUMNS, RISK_TYPES, _result_sql, planned_row_check
from veracity.sources.snapshots import in_order, previous_of

SUPPORTED_KEY_TYPES = KEY_TYPES


def _key_counts(history: DataFrame, snap: str, pairs: DataFrame, unique_keep: str) -> DataFrame:
    value: Column = kc._num(history, PAID) if PAID in history.columns else F.lit(None).cast("double")
    g = (history.select(F.col(snap).alias("snap"), F.col(CLAIM_KEY).cast("string").alias("k"), value.alias("v"))
                .where(F.col("snap").isNotNull())
                .groupBy("snap", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("cur_paid")))
    n = F.col("n")
    relabel = pairs.where(F.col("prev_snap").isNotNull()).select(F.col("snap").alias("next_snap"),
                                                                  F.col("prev_snap").alias("from_snap"))
    # the mapping has one row per snapshot (a bound set by the calendar, not the data), so it is
    # broadcast: a shuffle join on the snapshot column alone would put a whole snapshot in one task.
    # Both join sides read the same (count, sum) aggregate of ``g``, so its exchange is reused and
    # the history is grouped once; a null key never matches, so uniqueness (null group included)
    # and the continuity counts come from the same joined table.
    prev_side = (g.join(F.broadcast(relabel), g.snap == relabel.from_snap)
                  .select(F.col("next_snap").alias("snap"), "k", F.col("n").alias("prev_n"),
                          F.col("cur_paid").alias("prev_paid")))
    both = g.join(prev_side, ["snap", "k"], "full_outer")
    in_cur = n.isNotNull() & F.col("k").isNotNull()
    in_prev = F.col("prev_n").isNotNull() & F.col("k").isNotNull()   # unfiltered, so both sides stay identical
    ok = kc.paid_ok()
    return both.groupBy("snap").agg(
        F.sum("n").alias("u_total"), F.sum(F.when(n > 1, n).otherwise(0)).alias("u_failed"),
        F.count("n").alias("u_groups"),
        F.count_if(in_prev).alias("m_total"), F.count_if(in_prev & in_cur).alias("m_passed"),
        F.count_if(in_cur).alias("p_total"), F.count_if(in_cur & ok).alias("p_passed"))


def _risk_counts(history: DataFrame, snap: str, risk: DataFrame, key: str, ref_key: str, tag: str) -> DataFrame:
    cur = (history.select(F.col(snap).alias("snap"), F.col(key).cast("string").alias("k"))
                  .where(F.col("snap").isNotNull() & F.col("k").isNotNull()).distinct())
    ref = kc._keys(risk, ref_key).withColumn("found", F.lit(True))
    return cur.join(ref, "k", "left").groupBy("snap").agg(F.count(F.lit(1)).alias(f"{tag}_total"),
                                                          F.count("found").alias(f"{tag}_passed"))


def _ratio_counts(history: DataFrame, snap: str, risk: DataFrame) -> DataFrame:
    """The loss-ratio check of every snapshot: incurred per (snapshot, policy) against the reference."""
    sums = (history.select(F.col(snap).alias("snap"), F.col("policy_number").cast("string").alias("k"),
                           kc._num(history, "gross_incurred").alias("v"))
                   .where(F.col("snap").isNotNull() & F.col("k").isNotNull())
                   .groupBy("snap", "k").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")))
    ref = risk.select(F.col("risk_policy_number").cast("string").alias("k"), kc._num(risk, "gwp").alias("gwp"))
    ok = F.coalesce(F.try_divide("v", "gwp").between(0.0, 1.5), F.lit(False))
    return sums.join(ref, "k").groupBy("snap").agg(F.count(F.lit(1)).alias("l_total"), F.count_if(ok).alias("l_passed"))


def run_suite_by_snapshot(specs: Sequence[CheckSpec], policy: Policy, history: DataFrame, snap: str = "bdx_month",
                          risk: DataFrame | None = None, closed_values: Sequence[str] | None = None,
                          as_of_year: int | None = None) -> DataFrame:
    """Per-check results for every snapshot: the suite's result columns plus ``snapshot``."""
    if policy.paid_rule != "left" and any(s.enabled and s.type == "total_paid_non_decreasing_vs_prev" for s in specs):
        raise NotImplementedError(f"policy {policy.name!r}: validate its snapshots one run at a time")
    closed_values = list(closed_values or policy.closed_values)
    as_of_year = as_of_year or policy.as_of_year or _dt.date.today().year
    cols = rc.Cols(history.drop(snap), coerce=policy.coerce)

    aggs = [F.count(F.lit(1)).alias("n")]
    structs: list[str] = []
    uses_keys = uses_ratio = False
    references: dict[str, str] = {}   # reference key column -> prefix of its counts
    found = set(history.columns)
    for seq, spec in enumerate(s for s in specs if s.enabled):
        if spec.type in RISK_TYPES and risk is None and (policy.omit_risk_without_table or spec.type == "loss_ratio"):
            continue
        chk = planned_row_check(spec, policy, cols, closed_values, as_of_year)
        if chk is not None:
            if chk.error:
                structs.append(_error_sql(spec, seq, policy, chk.error))
            elif chk.missing:
                total = "n"
                if chk.missing_scope is not None:
                    aggs.append(F.count_if(chk.missing_scope).alias(f"t{seq}"))
                    total = f"t{seq}"
                structs.append(_result_sql(spec, seq, policy, total, "0", "0", "0",
                                           error=f"column not found: {chk.missing}"))
            else:
                aggs.append(F.count_if(chk.scope).alias(f"t{seq}"))
                aggs.append(F.count_if(chk.scope & F.coalesce(chk.ok, F.lit(False))).alias(f"p{seq}"))
                rate = scoring.pass_rate_sql(f"t{seq}", f"p{seq}", chk.empty_rate)
                structs.append(_result_sql(spec, seq, policy, f"t{seq}", f"p{seq}", f"t{seq} - p{seq}", rate))
            continue
        if spec.type not in SUPPORTED_KEY_TYPES:
            structs.append(_error_sql(spec, seq, policy, f"Unknown check type: {spec.type}"))
            continue
        if (spec.field if spec.type == "unique" else spec.key) not in (None, CLAIM_KEY) and spec.type not in RISK_TYPES \
                or (spec.paid or PAID) != PAID:
            raise NotImplementedError(f"check {spec.id!r}: its own key is not validated across snapshots")
        if spec.type in RISK_TYPES:
            if risk is None:
                structs.append(_skip_sql(spec, seq, policy, "reference table"))
                continue
            needed = [spec.key or "policy_number"] if spec.type == "risk_policy_match" else ["policy_number", "gross_incurred"]
            gone = [c for c in needed if c not in found]
            if spec.type == "loss_ratio":
                gone += [c for c in ("risk_policy_number", "gwp") if c not in risk.columns]
            if gone:
                structs.append(_result_sql(spec, seq, policy, "0", "0", "0", "0", error=f"column not found: {', '.join(gone)}"))
                continue
            if spec.type == "loss_ratio":
                uses_ratio, tag, empty = True, "l", 0.0
            else:
                ref = kc.resolve_risk_key(risk, spec.risk_key or "risk_policy_number", policy.risk_key_fallback)
                if ref is None:
                    n = "n" if policy.risk_key_fallback else "0"
                    structs.append(_result_sql(spec, seq, policy, n, "0", n, "0", error="reference key column not found"))
                    continue
                tag, empty = references.setdefault(f"{needed[0]}\n{ref}", f"r{len(references)}"), policy.empty_key_rate
            total, passed = f"coalesce({tag}_total, 0)", f"coalesce({tag}_passed, 0)"
            structs.append(_result_sql(spec, seq, policy, total, passed, f"{total} - {passed}",
                                       scoring.pass_rate_sql(total, passed, empty)))
            continue
        needed = [CLAIM_KEY, PAID] if spec.type == "total_paid_non_decreasing_vs_prev" else [CLAIM_KEY]
        gone = next((c for c in needed if c not in found), None)
        if spec.type == "unique":
            if gone:
                structs.append(_result_sql(spec, seq, policy, "n", "0", "0", "0", error=f"column not found: {gone}"))
                continue
            uses_keys = True
            total = "coalesce(u_total, 0)"
            passed = f"{total} - coalesce(u_failed, 0)" if policy.unique_keep == "none" else "coalesce(u_groups, 0)"
            rate = scoring.pass_rate_sql(total, passed, 0.0)
            structs.append(_result_sql(spec, seq, policy, total, passed, f"{total} - ({passed})", rate))
            continue
        if gone:
            ran = _result_sql(spec, seq, policy, "0", "0", "0", "0", error=f"column not found: {gone}")
        else:
            uses_keys = True
            tag, empty = ("m", policy.empty_key_rate) if spec.type == "missing_claims_from_prev_month" \
                else ("p", policy.paid_empty_rate)
            total, passed = f"coalesce({tag}_total, 0)", f"coalesce({tag}_passed, 0)"
            ran = _result_sql(spec, seq, policy, total, passed, f"{total} - {passed}",
                              scoring.pass_rate_sql(total, passed, empty))
        structs.append(f"CASE WHEN prev_snap IS NULL THEN {_skip_sql(spec, seq, policy, 'previous snapshot')} ELSE {ran} END")

    # the row-check aggregate has one row per snapshot: the snapshot list and each snapshot's previous
    # one come from it (a window over one row per snapshot), not from another pass over the history
    per_snap = history.groupBy(F.col(snap).alias("snap")).agg(*aggs).where(F.col("snap").isNotNull()) \
        .withColumn("prev_snap", previous_of("snap"))
    pairs = per_snap.select("snap", "prev_snap")
    if uses_keys:
        per_snap = per_snap.join(_key_counts(history, snap, pairs, policy.unique_keep), "snap", "left")
    for names, tag in references.items():
        per_snap = per_snap.join(_risk_counts(history, snap, risk, *names.split("\n"), tag), "snap", "left")
    if uses_ratio:
        per_snap = per_snap.join(_ratio_counts(history, snap, risk), "snap", "left")
    rows = per_snap.selectExpr("snap", f"inline(array({', '.join(structs)}))")
    rows = rows.withColumn("status", scoring.check_status(F.col("points_earned"), F.col("points_possible")))
    return rows.select(F.col("snap").alias("snapshot"), *RESULT_COLUMNS)


def _error_sql(spec: CheckSpec, seq: int, policy: Policy, error: str) -> str:
    return _result_sql(spec, seq, policy, "0", "0", "0", "0", error=error, earned="0")


def _skip_sql(spec: CheckSpec, seq: int, policy: Policy, what: str) -> str:
    if policy.skip_rule == "full":
        return _result_sql(spec, seq, policy, "0", "0", "0", "100", skipped=True, earned=repr(float(spec.points)))
    if policy.skip_rule == "zero":
        return _result_sql(spec, seq, policy, "0", "0", "0", "0", skipped=True)
    return _result_sql(spec, seq, policy, "0", "0", "0", "0", skipped=True, error=f"{what} not available", earned="0")


def scores_by_snapshot(checks: DataFrame, policy: Policy) -> DataFrame:
    """Overall score, status and summary per snapshot, with the change against the previous snapshot
    (a window over one row per snapshot)."""
    s = scoring.with_status(checks.groupBy("snapshot").agg(*scoring.score_aggs(policy)), policy)
    prev = in_order("snapshot", F.lag("overall_score").over(Window.orderBy("snapshot")))
    return s.withColumn("previous_score", prev).withColumn("score_change", F.col("overall_score") - prev)
