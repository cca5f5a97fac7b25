"""Key-, set- and snapshot-level checks as aggregations and joins.

Every function returns a one-row DataFrame ``(total, passed, failed)`` of
longs. Keys are always reduced first (``groupBy``/``distinct`` use partial
aggregation, so a hot key, null included, collapses map-side before the
shuffle, unless ``parts`` deals the rows to more partitions); the joins then run between deduplicated key sets, one row per key on
each side, so no join here can multiply a hot key.

``failing_*`` companions return the failing keys (or rows) as DataFrames; they
are lazy and cost nothing unless used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.coerce import as_double

# Reference-table key names tried when the configured one is absent.
RISK_KEY_FALLBACKS = ("risk_policy_number", "policy_number", "PolicyNumber", "Policy_Number")


def _result(df: DataFrame, total: Column, passed: Column, failed: Column | None = None) -> DataFrame:
    total = F.coalesce(total, F.lit(0)).cast("long")
    passed = F.coalesce(passed, F.lit(0)).cast("long")
    failed = (total - passed) if failed is None else F.coalesce(failed, F.lit(0)).cast("long")
    return df.agg(total.alias("total"), passed.alias("passed"), failed.alias("failed"))


def _num(df: DataFrame, name: str) -> Column:
    return as_double(F.col(name), df.schema[name].dataType)


def _keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys as strings."""
    return df.select(F.col(key).cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()


def _dealt(df: DataFrame, parts: int | None, *cols: str) -> DataFrame:
    """``df`` dealt by ``cols`` into ``parts`` partitions where the session's shuffle partitions are fewer, else ``df``. What a task
    then holds of a grouping by ``cols`` doesn't grow with the input; rows of a repeated value meet in one task before they
    are reduced, and it holds one of them."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(parts, *cols) if parts is not None and parts > few else df


# J1 / J2
def uniqueness(df: DataFrame, key: str, keep: str = "none") -> DataFrame:
    """Duplicate keys, nulls equal to each other.

    keep='none': every row of a duplicated key fails. keep='first': the first copy passes,
    so passed = number of key groups. Total = all rows.
    """
    groups = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    if keep == "none":
        failed = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
        return _result(groups, total, total - failed, failed)
    return _result(groups, total, F.count(F.lit(1)))


def failing_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once, nulls equal to each other. Rows without a key aren't
    shuffled: they fail together, by a count. The others are semi-joined with the duplicated keys, a
    deduplicated set, so a hot key on the row side is split by AQE skew handling."""
    dup = (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
             .where(F.col("__n") > 1).select("__k"))
    nulls = df.agg(F.count_if(F.col(key).isNull()).alias("n")).scalar()
    return df.where(F.col(key).isNotNull()).join(dup, F.col(key) == F.col("__k"), "left_semi") \
        .unionByName(df.where(F.col(key).isNull()).where(nulls > 1))


# J3
def missing_keys(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Distinct previous keys absent from the current snapshot. Total = distinct previous keys."""
    prev_k = _keys(previous, key)
    cur_k = _keys(current, key).withColumn("present", F.lit(True))
    joined = prev_k.join(cur_k, "k", "left")
    return _result(joined, F.count(F.lit(1)), F.count("present"))


def failing_missing_keys(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return _keys(previous, key).join(_keys(current, key), "k", "left_anti").withColumnRenamed("k", key)


def _paid_by_key(df: DataFrame, key: str, paid: str, alias: str) -> DataFrame:
    return (df.select(F.col(key).cast("string").alias("k"), _num(df, paid).alias("v"))
              .where(F.col("k").isNotNull())
              .groupBy("k").agg(F.sum("v").alias(alias)))


# Sums of doubles depend on the order of rows, which differs from run to run on a cluster: sums that
# are this close, relative to their size, count as equal.
PAID_TOLERANCE = 1e-9


def paid_ok() -> Column:
    """Whether a key's paid sum did not fall: true without a previous sum, false without a current one."""
    cur, prev = F.col("cur_paid"), F.col("prev_paid")
    slack = F.greatest(F.lit(1.0), F.abs(prev)) * PAID_TOLERANCE
    return cur.isNotNull() & (prev.isNull() | (cur >= prev - slack))


# J4
def paid_not_decreasing(current: DataFrame, previous: DataFrame, key: str, paid: str) -> DataFrame:
    """Sum paid per key in each snapshot, left join from current. New key passes; a null current
    sum fails. Total = current keys."""
    joined = (_paid_by_key(current, key, paid, "cur_paid")
              .join(_paid_by_key(previous, key, paid, "prev_paid"), "k", "left"))
    return _result(joined, F.count(F.lit(1)), F.count_if(paid_ok()))


def failing_paid_keys(current: DataFrame, previous: DataFrame, key: str, paid: str) -> DataFrame:
    return (_paid_by_key(current, key, paid, "cur_paid")
            .join(_paid_by_key(previous, key, paid, "prev_paid"), "k", "left")
            .where(~paid_ok()).withColumnRenamed("k", key))


# J5
HOT_KEYS = 128      # a key with more than 1/HOT_KEYS of the reduced rows is split into value buckets


def paid_not_decreasing_rows(current: DataFrame, previous: DataFrame, key: str, paid: str,
                             buckets: int = 128, parts: int | None = None) -> DataFrame:
    """Row-level pairs: every current row against every previous row of the same key (null keys
    match each other), pass when current paid >= previous paid; null paid fails.

    The pairs are never materialised. Both sides are first reduced to (key, paid) -> count; the
    number of pairs per key is n_cur * n_prev, and the passing pairs are counted with running sums
    of previous counts ordered by paid. Planning runs no job: cuts and hot keys are a one-row subplan. A hot
    key is split: its paid values fall into ordered buckets cut at global quantiles (an array of at most
    ``buckets`` values), running sums run within (key, bucket), and each bucket adds the previous counts of the
    lower buckets of its key, from one row per bucket of the hot keys alone. Any other key is one bucket. Which
    keys are split changes the work of a task, not the counts: exact for any key distribution. With ``parts`` above the
    session's shuffle partitions the groupings and windows get that many.
    """
    def side(df: DataFrame, cur: int) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("k"), _num(df, paid).alias("v"), F.lit(cur).alias("c"), F.lit(1 - cur).alias("p"))

    # rows are dealt by a hash of ``v``, the same for all that group as one (0.0 and -0.0); Spark shuffles again for a double itself
    rows = side(current, 1).unionByName(side(previous, 0)).withColumn("h", F.xxhash64(F.col("v") + F.lit(0.0)))
    dealt = _dealt(rows, parts, "k", "h")
    both = (dealt.groupBy("k", "v", *(["h"] if dealt is not rows else []))
            .agg(F.sum("c").alias("n_cur"), F.sum("p").alias("n_prev"))
            .where(F.col("n_cur") + F.col("n_prev") > 0))
    # the condition always holds; it makes every branch below need both counts, so that all of them have
    # the same exchange under them and Spark computes it once
    # bucket cuts: a quantile sketch over the reduced rows, which are exactly the window's rows; hot keys: a frequency
    # sketch whose error is far below their share. The null key counts as hot
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    spread = both.agg(F.percentile_approx("v", probs, 1000).alias("cuts"), F.expr(f"approx_top_k(k, {HOT_KEYS}, {32 * HOT_KEYS})").alias("top"),
                      F.count(F.lit(1)).alias("n")) \
        .select(F.struct("cuts", F.expr(f"transform(filter(top, x -> x.count > n / {HOT_KEYS}), x -> x.item)").alias("hot")).alias("s"))
    valued = F.col("v").isNotNull()
    b = both.withColumn("s", spread.scalar()).withColumn("cuts", F.col("s.cuts")) \
        .withColumn("hot", F.col("k").isNull() | F.coalesce(F.array_contains("s.hot", F.col("k")), F.lit(False))) \
        .withColumn("b", F.when(F.col("hot"), F.expr(_bucket(buckets))).otherwise(0)) \
        .select("k", "hot", "b", "v", "n_cur", "n_prev", F.when(valued, F.col("n_prev")).otherwise(0).alias("np"))
    group = Window.partitionBy("k", "b").orderBy("v")
    run = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead(F.lit(1)).over(group).isNull()
    within = _dealt(b, parts, "k", "b").select("hot", "v", "n_cur", last.alias("last"), F.sum("np").over(run).alias("prev_le"),
                      F.sum("n_cur").over(run).alias("all_cur"), F.sum("n_prev").over(run).alias("all_prev")) \
        .select(F.when(F.col("last") & ~F.col("hot"), F.col("all_cur") * F.col("all_prev")).otherwise(0).alias("pairs"),
                F.when(valued, F.col("n_cur") * F.col("prev_le")).otherwise(0).alias("ok"))
    # hot keys: at most ``buckets`` rows each
    lower = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    across = b.where("hot").groupBy("k", "b") \
        .agg(F.sum("n_cur").alias("c"), F.sum("n_prev").alias("p"), F.sum(F.when(valued, F.col("n_cur")).otherwise(0)).alias("vc"),
             F.sum("np").alias("np")) \
        .select((F.col("c") * F.sum("p").over(Window.partitionBy("k"))).alias("pairs"),
                (F.col("vc") * F.coalesce(F.sum("np").over(lower), F.lit(0))).alias("ok"))
    return _result(within.unionByName(across), F.sum("pairs"), F.sum("ok"))


def _bucket(buckets: int) -> str:
    """Number of cuts strictly below ``v``, as a balanced CASE tree over the array's elements: all
    inside whole-stage codegen (a higher-order ``filter`` over the cuts would be interpreted)."""
    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN v > get(cuts, {mid}) THEN {node(mid + 1, hi)} ELSE {node(lo, mid)} END"
    return node(0, max(1, buckets - 1))


def key_rows(current: DataFrame, previous: DataFrame | None, key: str, paid: str | None, parts: int | None = None) -> DataFrame:
    """One row a key: (k, n, cur_paid) and, with a previous snapshot, (prev_paid, in_prev). ``n`` is null for keys of the
    previous snapshot alone, whose null key doesn't count.

    Both snapshots go through ONE grouping, so a task holds one hash map of keys, and neither two of them nor the
    sorted sides of a join; with ``parts`` above the session's shuffle partitions, the keys of one of that many."""
    sides = [current] if previous is None else [current, previous]
    sums = bool(paid) and any(paid in df.columns for df in sides)      # else no task holds sums that are null for every key

    def value(df: DataFrame) -> Column:
        return _num(df, paid) if sums and paid in df.columns else F.lit(None).cast("double")

    def total(v: Column) -> Column:
        return F.sum(v) if sums else F.lit(None).cast("double")

    cur = current.select(F.col(key).cast("string").alias("k"), value(current).alias("v"))
    if previous is None:
        return _dealt(cur, parts, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), total(F.col("v")).alias("cur_paid"))
    prev = previous.select(F.col(key).cast("string").alias("k"), value(previous).alias("v")).where(F.col("k").isNotNull())
    both = cur.withColumn("old", F.lit(False)).unionByName(prev.withColumn("old", F.lit(True)))
    return _dealt(both, parts, "k").groupBy("k").agg(
        F.nullif(F.count_if(~F.col("old")), F.lit(0)).alias("n"), total(F.when(~F.col("old"), F.col("v"))).alias("cur_paid"),
        total(F.when(F.col("old"), F.col("v"))).alias("prev_paid"), F.max("old").alias("in_prev"))


def key_profile(current: DataFrame, previous: DataFrame | None, key: str, paid: str | None,
                unique_keep: str = "none", parts: int | None = None) -> DataFrame:
    """Uniqueness (J1/J2), missing keys (J3) and paid-not-decreasing (J4) from ONE grouping of both
    snapshots on the key, after map-side partial aggregation, or dealt into ``parts`` partitions where the session's shuffle
    partitions are fewer. One row out with the counts of all three checks.
    """
    rows = key_rows(current, previous, key, paid, parts)
    return _profile(rows, previous is not None)


def failing_records(current: DataFrame, previous: DataFrame | None, key: str, paid: str | None,
                    unique: Sequence[str], missing: Sequence[str], decreased: Sequence[str], limit: int,
                    with_profile: bool = False, parts: int | None = None) -> DataFrame:
    """(check_id, record): the failing keys of the checks named in ``unique`` (one record a row of the key, at most
    ``limit``), ``missing`` and ``decreased``. ``with_profile``: from the grouping that ``key_profile`` makes, so in one
    plan with it both snapshots are shuffled once for both; else each snapshot is grouped by itself, and their keys are joined."""
    if with_profile or previous is None:
        keys = key_rows(current, previous, key, paid, parts)
    else:
        prev = key_rows(previous, None, key, paid, parts).where(F.col("k").isNotNull()) \
            .select("k", F.col("cur_paid").alias("prev_paid"), F.lit(True).alias("in_prev"))
        keys = key_rows(current, None, key, paid, parts).join(prev, "k", "full_outer")
    n, one = F.col("n"), F.lit(1)
    fails = [(i, n > 1, F.least(n, F.lit(limit)).cast("int")) for i in unique]
    if previous is not None:
        fails += [(i, F.coalesce("in_prev", F.lit(False)) & n.isNull(), one) for i in missing]
        fails += [(i, F.col("k").isNotNull() & n.isNotNull() & ~paid_ok(), one) for i in decreased]
    entries = [F.when(failed, F.struct(F.lit(check_id).alias("check_id"), rows.alias("rows"))) for check_id, failed, rows in fails]
    return keys.select("k", F.explode(F.array_compact(F.array(*entries))).alias("e")) \
        .select("e.check_id", F.explode(F.array_repeat("k", F.col("e.rows"))).alias("record"))


def profile_counts(cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    """The counts of ``key_profile`` from one row a key: (k, n, cur_paid) of the current snapshot and
    (k, prev_paid, in_prev) of the previous one, which has no null key."""
    return _profile(cur if prev is None else cur.join(prev, "k", "full_outer"), prev is not None)


def _profile(rows: DataFrame, with_previous: bool) -> DataFrame:
    n = F.col("n")
    aggs = [F.sum("n").alias("u_total"), F.sum(F.when(n > 1, n).otherwise(0)).alias("u_failed"),
            F.count("n").alias("u_groups")]
    if with_previous:
        in_cur = F.col("k").isNotNull() & n.isNotNull()
        in_prev = F.coalesce(F.col("in_prev"), F.lit(False))
        aggs += [F.count_if(in_prev).alias("m_total"), F.count_if(in_prev & in_cur).alias("m_passed"),
                 F.count_if(in_cur).alias("p_total"), F.count_if(in_cur & paid_ok()).alias("p_passed")]
    return rows.agg(*aggs)


def key_state(claims: DataFrame, key: str, paid: str) -> DataFrame:
    """One row a key (text; nulls are one key): its rows ``n`` and its paid sum."""
    value = _num(claims, paid) if paid in claims.columns else F.lit(None).cast("double")
    return claims.select(F.col(key).cast("string").alias(key), value.alias("v")) \
        .groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias(paid))


def failing_paid_rows(current: DataFrame, previous: DataFrame, key: str, paid: str) -> DataFrame:
    """Current rows that fail against at least one previous row of their key (null keys match each
    other): a null on either side, or a higher previous value. The previous side is one row a key."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()
    prev = previous.select(k[0].alias("__k"), k[1].alias("__n"), _num(previous, paid).alias("v")).groupBy("__k", "__n") \
        .agg(F.max("v").alias("__most"), F.count_if(F.col("v").isNull()).alias("__nulls"))
    now = F.col("__now")
    cur = current.withColumn("__k", k[0]).withColumn("__n", k[1]).withColumn("__now", _num(current, paid))
    return cur.join(prev, ["__k", "__n"]).where(now.isNull() | (F.col("__nulls") > 0) | (now < F.col("__most"))) \
        .select(*current.columns)


def resolve_risk_key(risk: DataFrame, wanted: str, fallback: bool = True) -> str | None:
    """The configured reference key, else (with ``fallback``) the first other name present, else None."""
    if wanted in risk.columns:
        return wanted
    if not fallback:
        return None
    for name in RISK_KEY_FALLBACKS:
        if name in risk.columns:
            return name
    return None


# J6
def keys_in_reference(claims: DataFrame, reference: DataFrame, key: str, ref_key: str) -> DataFrame:
    """Distinct claim keys found in the reference table. Total = distinct claim keys."""
    ref = _keys(reference, ref_key).withColumn("found", F.lit(True))
    joined = _keys(claims, key).join(ref, "k", "left")
    return _result(joined, F.count(F.lit(1)), F.count("found"))


def failing_reference_keys(claims: DataFrame, reference: DataFrame, key: str, ref_key: str) -> DataFrame:
    return _keys(claims, key).join(_keys(reference, ref_key), "k", "left_anti").withColumnRenamed("k", key)


def matched_reference_keys(claims: DataFrame, reference: DataFrame, key: str, ref_key: str) -> DataFrame:
    return _keys(claims, key).join(_keys(reference, ref_key), "k", "left_semi").withColumnRenamed("k", key)


# J8
def loss_ratio_table(claims: DataFrame, risk: DataFrame, key: str = "policy_number",
                     incurred: str = "gross_incurred", ref_key: str = "risk_policy_number",
                     premium: str = "gwp", low: float = 0.0, high: float = 1.5) -> DataFrame:
    """Incurred summed per key (null keys dropped, all-null sums read as 0), inner-joined to the
    reference rows; ``ok`` when incurred / premium lies in [low, high]. Division by zero fails."""
    agg = (claims.select(F.col(key).cast("string").alias("k"), _num(claims, incurred).alias("v"))
                 .where(F.col("k").isNotNull())
                 .groupBy("k").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total_incurred")))
    # every key is at least '': the condition drops none, and tells the optimiser that this side restricts the
    # other, so it may filter the claims by a Bloom filter of these keys before they are grouped and shuffled
    ref = risk.select(F.col(ref_key).cast("string").alias("k"), _num(risk, premium).alias("gwp")).where(F.col("k") >= "")
    joined = agg.join(ref, "k", "inner")
    ratio = F.try_divide(F.col("total_incurred"), F.col("gwp"))
    return (joined.withColumn("loss_ratio", ratio)
                  .withColumn("ok", F.coalesce(F.col("loss_ratio").between(low, high), F.lit(False)))
                  .withColumnRenamed("k", key))


def loss_ratio(claims: DataFrame, risk: DataFrame, **kw) -> DataFrame:
    t = loss_ratio_table(claims, risk, **kw)
    return _result(t, F.count(F.lit(1)), F.count_if(F.col("ok")))


def constant_result(spark, total: int | Column, passed: int | Column, failed: int | Column) -> DataFrame:
    return spark.range(1).select(F.lit(total).cast("long").alias("total"),
                                 F.lit(passed).cast("long").alias("passed"),
                                 F.lit(failed).cast("long").alias("failed"))


def count_rows(df: DataFrame, cond: Column | None = None) -> DataFrame:
    c = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.agg(c.cast("long").alias("n"))


__all__: Sequence[str] = [
    "uniqueness", "failing_duplicates", "missing_keys", "failing_missing_keys", "paid_not_decreasing",
    "failing_paid_keys", "paid_not_decreasing_rows", "resolve_risk_key", "keys_in_reference",
    "failing_reference_keys", "matched_reference_keys", "loss_ratio_table", "loss_ratio",
]
