"""Run reports and result tables (scores, per-check results, issues, trend).

All report frames are derived from the small per-check results of a run; the
only wide work is the failing-identifier list, one pass for all row checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.text import category_label, pass_rate_text, points_text
from veracity.operators import keychecks as kc
from veracity.plans import scoring as sc
from veracity.plans.spec import SCORE_CATEGORIES_V5
from veracity.plans.suite import CLAIM_KEY, PAID, RESULT_COLUMNS, SuiteRun

FAILED_RECORDS_KEPT = 100


def _key_name(cat: str) -> str:
    return cat.lower().replace("-", "_").replace(" ", "_")


def _dec(c: Column) -> Column:
    return c.cast("decimal(5,2)")


# A10 + A17 "Summary"
def summary_table(run: SuiteRun, quarter_id: str, total_records: DataFrame) -> DataFrame:
    """One aggregate over the check rows plus the one-row record count (unioned in, not joined)."""
    rows = run.checks.unionByName(total_records, allowMissingColumns=True)
    s = sc.with_status(rows.agg(*sc.score_aggs(run.policy), F.max("n").alias("total_records")), run.policy)
    return s.select(F.lit(quarter_id).alias("quarter_id"), "overall_score", "status", "total_records",
                    "total_checks", "passed_checks", "warning_checks", "failed_checks", "critical_issues_count")


# A17 "Category Scores"
def category_table(run: SuiteRun) -> DataFrame:
    return run.categories().select(category_label(F.col("category")).alias("category"), "percentage",
                                   "points_earned", "points_possible")


# A17 "Detailed Results" with the display texts (P9)
def detail_table(run: SuiteRun) -> DataFrame:
    c = run.checks
    return c.select("seq", "check_id", "check_name", "priority", category_label(F.col("category")).alias("category"),
                    pass_rate_text(F.col("pass_rate")).alias("pass_rate_text"), "passed", "failed", "total",
                    "points_earned", "points_possible",
                    points_text(F.col("points_earned"), F.col("points_possible")).alias("points_text"), "status")


# A17 "Risk Reconciliation": the reference-table check on its own
def risk_reconciliation(run: SuiteRun) -> DataFrame:
    # Result texts of the reconciliation sheet.
    ok_text, fail_text = "PASS - Claims data matches with risk data", "FAIL"
    risk = run.checks.where(F.col("check_type") == "risk_policy_match")
    return risk.select("check_name",
                       F.when(F.col("pass_rate") == 100.0, ok_text).otherwise(fail_text).alias("result"),
                       pass_rate_text(F.col("pass_rate")).alias("pass_rate_text"),
                       F.col("passed").alias("matched"), F.col("failed").alias("unmatched"))


# F5 / A17 "Failed Checks"
def failed_checks_table(run: SuiteRun) -> DataFrame:
    return detail_table(run).where(F.col("points_earned") < F.col("points_possible"))


# F4
def filter_results(detail: DataFrame, statuses: Sequence[str] | None = None,
                   categories: Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(True)
    if statuses is not None:
        cond = cond & F.col("status").isin(list(statuses))
    if categories is not None:
        cond = cond & F.col("category").isin(list(categories))
    return detail.where(cond)


# J10: failing identifiers of all checks
def failed_records(run: SuiteRun, limit: int | None = FAILED_RECORDS_KEPT, key: str = "claim_number",
                   check_ids: Sequence[str] | None = None, with_checks: bool = False) -> DataFrame:
    """(check_id, record): the failing rows' identifiers, for each check the first ``limit`` in sorted
    order (None: all). The row checks share one pass, which gives each row an array of the checks it
    fails; with a limit the checks on claim numbers share one grouping a snapshot, and the window keeps that many
    per check and task before the shuffle. ``with_checks``: the list is evaluated in one plan with the check rows, so it
    takes the key profile's grouping."""
    entries, parts, by_key = [], [], {}
    for spec in run.specs:
        if not spec.enabled or (check_ids is not None and spec.id not in check_ids):
            continue
        if spec.id in run.row_checks:
            check = run.row_checks[spec.id]
            if check.missing or check.error:
                continue
            columns = run.context_columns(spec)
            record = F.col(f"`{key if key in columns else columns[0]}`").cast("string")
            entries.append(F.when(check.scope & ~F.coalesce(check.ok, F.lit(False)),
                                  F.struct(F.lit(spec.id).alias("check_id"), record.alias("record"))))
        elif limit is not None and key == CLAIM_KEY and (role := run.claim_key_role(spec)) is not None:
            by_key.setdefault(role, []).append(spec.id)
        elif (keys := run.failing_keys(spec)) is not None:
            name = key if key in keys.columns else keys.columns[0]
            parts.append(keys.select(F.lit(spec.id).alias("check_id"), F.col(f"`{name}`").cast("string").alias("record")))
    if entries:
        parts.insert(0, run.current.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*"))
    if by_key:
        parts.append(kc.failing_records(run.current, run.previous if by_key.keys() & {"m", "p"} else None, CLAIM_KEY,
                                        PAID if "p" in by_key else None, *(by_key.get(r, ()) for r in "ump"), limit, with_checks,
                                        run.key_parts))
    if not parts:
        return run.checks.sparkSession.createDataFrame([], "check_id string, record string")
    rows = reduce(DataFrame.unionByName, parts)
    if limit is None:
        return rows
    first = Window.partitionBy("check_id").orderBy(F.col("record").asc_nulls_first())
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).drop("n")


def failed_records_json(run: SuiteRun, check_ids: Sequence[str] | None = None,
                        limit: int | None = FAILED_RECORDS_KEPT) -> DataFrame:
    """(check_id, failed_records_json) of the checks with failing rows: sorted identifiers as JSON text."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("record"))), lambda x: x["record"])
    return failed_records(run, limit, check_ids=check_ids, with_checks=True).groupBy("check_id").agg(F.to_json(listed).alias("failed_records_json"))


# S9
def dq_scores_row(run: SuiteRun, quarter_id: str, run_timestamp: str, total_records: DataFrame,
                  categories: Sequence[str] = SCORE_CATEGORIES_V5, source_database: str | None = None,
                  source_table: str | None = None, bdx_month: str | None = None) -> DataFrame:
    """One row per run with the category scores pivoted into fixed columns: a single aggregate over
    the check rows and the one-row record count."""
    rows = run.checks.unionByName(total_records, allowMissingColumns=True)
    wide = sc.with_status(rows.agg(*sc.score_aggs(run.policy), *sc.category_aggs(categories),
                                   F.max("n").alias("total_records")), run.policy)
    return wide.select(
        F.lit(quarter_id).alias("quarter_id"),
        F.lit(run_timestamp).cast("timestamp_ntz").alias("run_timestamp"),
        F.lit(source_database).cast("string").alias("source_database"),
        F.lit(source_table).cast("string").alias("source_table"),
        F.lit(bdx_month).cast("string").alias("bdx_month"),
        "total_records", _dec(F.col("overall_score")).alias("overall_score"), "status",
        *[c for cat in categories for c in (f"{_key_name(cat)}_score", f"{_key_name(cat)}_points")],
        "total_checks", "passed_checks", "warning_checks", "failed_checks", "critical_issues_count")


# S10
def dq_check_results(run: SuiteRun, quarter_id: str, run_timestamp: str, with_json: bool = True,
                     failed_limit: int | None = FAILED_RECORDS_KEPT) -> DataFrame:
    """One row a check. ``failed_limit`` identifiers of failing rows are kept with it (None: all)."""
    c = run.checks
    out = c.select(
        F.lit(quarter_id).alias("quarter_id"), F.lit(run_timestamp).cast("timestamp_ntz").alias("run_timestamp"),
        "category", "subcategory", "check_id", "check_name", "priority",
        _dec(F.col("pass_rate")).alias("pass_rate"), F.col("passed").alias("passed_count"),
        F.col("failed").alias("failed_count"), F.col("total").alias("total_count"),
        "points_possible", "points_earned", "status")
    if with_json:
        kept = run.listed if failed_limit == FAILED_RECORDS_KEPT else None
        out = out.join(failed_records_json(run, limit=failed_limit) if kept is None else kept, "check_id", "left") \
            .withColumn("failed_records_json", F.coalesce("failed_records_json", F.lit("[]")))
    return out


# S11
def dq_issues(check_results: DataFrame) -> DataFrame:
    cols = ["quarter_id", "run_timestamp", "category", "subcategory", "check_id", "check_name", "priority",
            "pass_rate", "failed_count", "total_count"]
    if "failed_records_json" in check_results.columns:
        cols.append("failed_records_json")
    return (check_results.where(F.col("points_earned") < F.col("points_possible"))
            .select(*cols, F.lit(False).alias("resolved")))


def append(df: DataFrame, path: str) -> None:
    """Append a run's rows to a result table (the first append creates it)."""
    df.write.mode("append").parquet(path)


# S12
def existing_run(scores: DataFrame, quarter_id: str) -> DataFrame:
    return scores.agg((F.count_if(F.col("quarter_id") == quarter_id) > 0).alias("run_exists"))


# S13
def results_json(run: SuiteRun, quarter_id: str, run_timestamp: str) -> DataFrame:
    """The run as one JSON document: run and score fields, then categories with their scores, their
    subcategories and checks, all in suite order (lists bounded by the suite's size)."""
    checks = run.checks.unionByName(run.total_records(), allowMissingColumns=True)
    score = sc.with_status(checks.agg(*sc.score_aggs(run.policy), F.max("n").alias("total_records"),
                                      _categories().alias("categories")), run.policy)
    head = [F.lit(quarter_id).alias("quarter_id"), F.lit(run_timestamp).alias("timestamp"), "total_records", "overall_score",
            "status", "total_checks", "passed_checks", "warning_checks", "failed_checks", "critical_issues_count",
            "risk_match_ok", "categories"]
    return score.select(F.to_json(F.struct(*head), {"ignoreNullFields": "false"}).alias("results_json"))


def _categories() -> Column:
    """Check rows nested as category, subcategory, checks; each level in order of its first check."""
    rows = F.sort_array(F.collect_list(F.when(F.col("check_id").isNotNull(), F.struct(*RESULT_COLUMNS))))

    def under(of: Column, name: str) -> Column:
        return F.array_distinct(F.transform(of, lambda r: r[name]))

    def total(of: Column, name: str) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, r: a + r[name])

    def subcategory(of: Column, name: Column) -> Column:
        return F.struct(name.alias("subcategory"), F.filter(of, lambda r: r["subcategory"] == name).alias("checks"))

    def category(name: Column) -> Column:
        own = F.filter(rows, lambda r: r["category"] == name)
        earned, possible = total(own, "points_earned"), total(own, "points_possible")
        return F.struct(name.alias("category"),
                        F.when(possible > 0, earned / possible * 100.0).otherwise(0.0).alias("percentage"),
                        earned.alias("points_earned"), possible.alias("points_possible"),
                        F.transform(under(own, "subcategory"), lambda s: subcategory(own, s)).alias("subcategories"))
    return F.transform(under(rows, "category"), category)


# A19
def score_trend(scores: DataFrame, line_col: str = "business_line", order_col: str = "quarter_id") -> DataFrame:
    """Each run against the previous run of the same line. Of several runs of one quarter the latest
    counts (``run_timestamp``, where the table has it). One row per run, so a window partition holds
    the run history of one line (bounded by calendar time, not data volume)."""
    if "run_timestamp" in scores.columns:
        scores = scores.groupBy(line_col, order_col).agg(F.max_by("overall_score", "run_timestamp").alias("overall_score"))
    w = Window.partitionBy(line_col).orderBy(order_col)
    prev = F.lag("overall_score").over(w)
    return scores.select(line_col, order_col, "overall_score", prev.alias("previous_score"),
                         (F.col("overall_score") - prev).alias("score_change"))


# Column labels of the failing identifiers of the key checks.
IDENTIFIER_LABELS = {
    "missing_claims_from_prev_month": "Missing Claim Number",
    "total_paid_non_decreasing_vs_prev": "Claim Number (Paid Decreased)",
    "risk_policy_match": "Policy Number (Not in Risk Table)",
}


# A17 export (the workbook re-aimed as files): four report tables, one folder each
def write_reports(run: SuiteRun, path: str, quarter_id: str, fmt: str = "parquet") -> None:
    """The run is evaluated once, then written as four tables."""
    run.materialize()
    tables = {
        "summary": summary_table(run, quarter_id, run.total_records()),
        "category_scores": category_table(run),
        "detailed_results": detail_table(run),
        "failed_checks": failed_checks_table(run),
    }
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{path}/{name}")


# J9 export: the failing rows (or identifiers) of every check that has failures, one folder per check
def write_failures(run: SuiteRun, path: str, fmt: str = "parquet") -> list[str]:
    """Writes each enabled check's failing rows with their context columns (key checks: the failing
    identifiers under their label). Distributed writes; nothing is collected. Returns the check ids."""
    written = []
    for spec in run.specs:
        if not spec.enabled or (spec.id not in run.row_checks and run.failing_keys(spec) is None):
            continue
        rows = run.failing(spec.id)
        label = IDENTIFIER_LABELS.get(spec.type)
        if label and len(rows.columns) == 1:
            rows = rows.withColumnRenamed(rows.columns[0], label)
        w = rows.write.mode("overwrite")
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{path}/check_{spec.id}")
        written.append(spec.id)
    return written


# J9 in one pass
def failing_rows(run: SuiteRun, check_ids: Sequence[str] | None = None) -> DataFrame:
    """The failing rows of all checks: check_id, the context columns of any row check (null where a check
    doesn't show them), identifier_label and identifier (of checks on keys).

    One pass over the current snapshot tags each row with the checks it fails. Where the run has key states, the
    rows of duplicated keys are tagged in that pass too, by a join with those keys, and the other claim-keyed checks read
    states only; without them, each key check adds its own failing keys."""
    chosen = [s for s in run.specs if s.enabled and (check_ids is None or s.id in check_ids)]
    tags: list[tuple[str, Column]] = []
    shown: dict[str, list[str]] = {}
    parts: list[DataFrame] = []
    rows = run.current
    for spec in chosen:
        if spec.id in run.row_checks:
            check = run.row_checks[spec.id]
            if check.missing or check.error:
                continue
            tags.append((spec.id, check.scope & ~F.coalesce(check.ok, F.lit(False))))
            columns = run.context_columns(spec)
        elif spec.type == "unique" and run.keys is not None and (spec.field or run.keys.key) == run.keys.key:
            rows, failed = _with_duplicates(rows, run.keys.duplicated(), run.keys.key)
            tags.append((spec.id, failed))
            columns = [run.keys.key]
        elif (keys := run.failing_keys(spec)) is not None:
            if len(keys.columns) == 1 and spec.type != "unique":
                label = IDENTIFIER_LABELS.get(spec.type, keys.columns[0])
                parts.append(keys.select(F.lit(spec.id).alias("check_id"), F.lit(label).alias("identifier_label"),
                                         F.col(f"`{keys.columns[0]}`").cast("string").alias("identifier")))
            else:
                parts.append(keys.select(F.lit(spec.id).alias("check_id"), *(F.col(f"`{c}`") for c in keys.columns)))
            continue
        else:
            continue
        for c in columns:
            shown.setdefault(c, []).append(spec.id)
    if tags:
        failed = F.array_compact(F.array(*(F.when(cond, F.lit(i)) for i, cond in tags)))
        tagged = rows.select(F.explode(failed).alias("__check"), *(F.col(f"`{c}`") for c in shown))
        parts.insert(0, tagged.select(F.col("__check").alias("check_id"), *(
            F.when(F.col("__check").isin(ids), F.col(f"`{c}`")).alias(c) for c, ids in shown.items())))
    if not parts:
        return run.checks.sparkSession.createDataFrame([], "check_id string, identifier_label string, identifier string")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for c in ("identifier_label", "identifier"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


NULL_SALTS = 1024


def _with_duplicates(rows: DataFrame, duplicated: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``rows`` and the condition that their key is among ``duplicated``, the null key included. Rows without a key are
    spread over ``NULL_SALTS`` join keys that match nothing, so they don't meet in one task."""
    known = duplicated.where(F.col(key).isNotNull()).select(F.col(key).alias("__duplicated"))
    nulls = duplicated.agg(F.count_if(F.col(key).isNull()).alias("n")).scalar()
    k = F.col(f"`{key}`").cast("string")
    salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(NULL_SALTS)).cast("string"))
    joined = rows.join(known, (F.coalesce(k, salt) == F.col("__duplicated")) & k.isNotNull(), "left")
    return joined, F.when(k.isNull(), nulls > 0).otherwise(F.col("__duplicated").isNotNull())


def write_failing_rows(run: SuiteRun, path: str, fmt: str = "parquet") -> None:
    """All failing rows in one write, a folder ``check=check_<id>`` a check."""
    rows = failing_rows(run).withColumn("check", F.concat(F.lit("check_"), "check_id"))
    w = rows.write.mode("overwrite").partitionBy("check")
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(path)
