"""What is kept between runs: key states, stored runs, failing rows in one pass, layouts, file sets, metadata."""
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from veracity.functions.elect import elect_dates, elected_layouts
from veracity.operators import keychecks as kc
from veracity.plans import reports as rp
from veracity.plans.config import specs_from_config
from veracity.plans.keystate import KeyStates
from veracity.plans.runstore import RunStore
from veracity.plans.spec import POLICIES, CheckSpec, default_suite
from veracity.plans.suite import run_suite
from veracity.sources import files, metadata
from veracity.sources import fixtures as fx
from veracity.sources.commitlog import CommitLog

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-arrivals-", dir="/tmp")


def claims(spark, rows):
    return spark.createDataFrame(rows, "claim_number string, total_paid double")


JAN = [("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 1.0), ("gone", 3.0), ("null", None)] + [("hot", 1.0)] * 50
FEB = [("a", 3.0), ("b", 4.0), ("b", None), (None, 1.0), (None, 2.0), ("new", None), ("null", 0.0)] + [("hot", 1.0)] * 60


def test_states_equal_the_key_profile(spark, folder):
    states = KeyStates(spark, folder, buckets=4)
    jan, feb = claims(spark, JAN).repartition(3), claims(spark, FEB).repartition(5)
    first = states.arrive("2024-01-01 00:00:00", jan)
    assert first.previous is None
    assert first.profile().first() == kc.key_profile(jan, None, "claim_number", "total_paid").first()
    keys = states.arrive("2024-02-01 00:00:00", feb)
    assert keys.profile().first() == kc.key_profile(feb, jan, "claim_number", "total_paid").first()
    assert [r[0] for r in keys.missing().collect()] == ["gone"]
    assert sorted(r[0] for r in keys.decreased().collect()) == ["b", "new"]
    assert sorted(str(r[0]) for r in keys.duplicated().collect()) == ["None", "b", "hot"]
    # a snapshot that comes again takes the place of its state; one that wasn't committed is not seen
    states.record("2024-01-01 00:00:00", claims(spark, [("a", 9.0)]))
    states._table(f"{folder}/states/left", of=kc.key_state(claims(spark, [("x", 1.0)]), "claim_number", "total_paid"))
    assert sorted(r[0] for r in states.arrived("2024-02-01 00:00:00").decreased().collect()) == ["a", "new"]
    assert states.snapshots().count() == 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("veracity_keys")]


def test_bucket_count_stays_with_the_states(spark, folder):
    KeyStates(spark, folder, buckets=4).record("2024-01-01", claims(spark, JAN))
    again = KeyStates(spark.newSession(), folder)
    assert again.buckets == 4
    assert again.arrive("2024-02-01", claims(spark, FEB)).profile().first().m_total == 5
    with pytest.raises(ValueError, match="4 buckets"):
        KeyStates(spark, folder, buckets=8)
    with pytest.raises(KeyError):
        again.arrived("2024-03-01")


def test_arriving_month_reads_no_claims_and_moves_no_state(spark, folder):
    states = KeyStates(spark, folder, buckets=4)
    states.record("1", fx.claims_snapshot(spark, SF, False))
    keys = states.arrive("2", fx.claims_snapshot(spark, SF, True))
    plan = plan_text(keys.profile())
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and "BroadcastExchange" not in plan
    assert "lineitem" not in plan and plan.count("FileScan parquet") == 2
    assert plan.count("SelectedBucketsCount: 4 out of 4") == 2 or plan.count("Bucketed: true") == 2
    run = run_suite(default_suite(), POLICIES["v5"], fx.claims_snapshot(spark, SF, True), None, None, ["Closed"], 2002, keys=keys)
    assert plan_text(run.checks).count("l_orderkey") > 0
    usual = run_suite(default_suite(), POLICIES["v5"], fx.claims_snapshot(spark, SF, True), fx.claims_snapshot(spark, SF, False), None, ["Closed"], 2002)
    assert sorted(map(str, run.checks.collect())) == sorted(map(str, usual.checks.collect()))


def _run(spark, policy="v5"):
    return run_suite(default_suite(), POLICIES[policy], fx.claims_snapshot(spark, SF, True), None, None, ["Closed"], 2002)


def test_killed_run_leaves_nothing_and_can_be_repeated(spark, folder, monkeypatch):
    store = RunStore(spark, folder)
    with pytest.raises(ValueError, match="no run"):
        store.read("dq_scores")
    assert not store.existing_run("2024_Q1").first()[0]
    store.save(_run(spark), "2023_Q4", "2023-10-01 00:00:00")
    stage = RunStore.stage

    def killed(self, run_id, quarter_id, tables):
        if "dq_issues" in tables:
            raise RuntimeError("killed")
        return stage(self, run_id, quarter_id, tables)
    monkeypatch.setattr(RunStore, "stage", killed)
    with pytest.raises(RuntimeError):
        store.save(_run(spark), "2024_Q1", "2024-01-01 00:00:00", run_id="r1")
    assert os.path.isdir(f"{folder}/dq_scores/quarter_part=q-2024_Q1")
    for table in ("dq_scores", "dq_check_results", "dq_issues"):
        assert {r.quarter_id for r in store.read(table).select("quarter_id").collect()} == {"2023_Q4"}
    assert not store.existing_run("2024_Q1").first()[0]
    monkeypatch.undo()
    for _ in range(2):
        assert store.save(_run(spark), "2024_Q1", "2024-01-01 00:00:00", run_id="r1") == "r1"
    assert store.read("dq_scores", "2024_Q1").count() == 1 and store.existing_run("2024_Q1").first()[0]
    issues = {(r.quarter_id, r.check_id, r.failed_records_json) for r in store.read("dq_issues").collect()}
    results = {(r.quarter_id, r.check_id, r.failed_records_json) for r in store.read("dq_check_results").collect() if r.points_earned < r.points_possible}
    assert issues == results and len(issues) > 2


def test_a_repeated_quarter_is_replaced_and_pruned(spark, folder):
    store = RunStore(spark, folder)
    for n, (quarter, policy, replace) in enumerate([("2024/Q1 é", "v4", False), ("2024_Q2", "v5", False), ("2024/Q1 é", "v5", True), ("2024_Q2", "v4", False)]):
        store.save(_run(spark, policy), quarter, f"2024-01-0{n + 1} 00:00:00", replace=replace)
    scores = store.read("dq_scores")
    assert sorted((r.quarter_id, r.run_timestamp.day) for r in scores.collect()) == [("2024/Q1 é", 3), ("2024_Q2", 2), ("2024_Q2", 4)]
    one = store.read("dq_check_results", "2024/Q1 é")
    assert one.count() == 16 and "quarter_part" not in one.columns
    assert re.search(r"PartitionFilters: \[[^\]]*quarter_part#\d+ = q-2024/Q1 é", plan_text(one))


def test_two_writers_take_different_numbers(spark, folder):
    one, two = (CommitLog(spark, folder, "name string") for _ in range(2))
    two._next = lambda: 1                                       # has listed the log before the other wrote
    assert one.append({"name": "a"}) == 1 and two.append({"name": "b\"é"}) == 2
    open(f"{folder}/00000003.json", "w").close()               # its writer died
    assert sorted((r.number, r.name) for r in one.read().collect()) == [(1, "a"), (2, "b\"é")]
    assert one.append({"name": "c"}) == 4


def test_failing_rows_come_from_one_scan(spark, folder):
    fx.claims_snapshot(spark, SF, True).write.parquet(f"{folder}/current")
    states = KeyStates(spark, f"{folder}/keys", buckets=4)
    states.record("1", fx.claims_snapshot(spark, SF, False))
    current, risk = spark.read.parquet(f"{folder}/current"), fx.risk_table(spark, SF)
    specs = default_suite(include_risk=True)
    run = run_suite([s for s in specs if s.type != "risk_policy_match"], POLICIES["v5"], current, None, None, ["Closed"], 2002,
                    keys=states.arrive("2", current))
    rows = rp.failing_rows(run)
    scans = [line for line in plan_text(rows).splitlines() if "FileScan" in line and f"{folder}/current" in line]
    assert len(scans) == 1
    usual = run_suite(specs, POLICIES["v5"], current, fx.claims_snapshot(spark, SF, False), risk, ["Closed"], 2002)
    full = run_suite(specs, POLICIES["v5"], current, None, risk, ["Closed"], 2002, keys=states.arrived("2"))
    for got in (rp.failing_rows(usual), rp.failing_rows(full)):
        got = got.cache()
        for spec in specs:
            mine = got.where(F.col("check_id") == spec.id)
            expected = usual.failing(spec.id)
            cols = expected.columns if mine.where("identifier is not null").limit(1).count() == 0 else ["identifier"]
            assert sorted(map(str, map(tuple, mine.select(*cols).collect()))) == sorted(map(str, map(tuple, expected.collect()))), spec.id
    rp.write_failing_rows(full, f"{folder}/out")
    back = spark.read.parquet(f"{folder}/out")
    assert {(r.check, r["count"]) for r in back.groupBy("check").count().collect()} == \
        {(f"check_{r.check_id}", r["count"]) for r in rp.failing_rows(full).groupBy("check_id").count().collect()}


def test_failing_rows_without_checks(spark):
    run = run_suite([CheckSpec("1", "x", "telepathy", "c", "s", 1)], POLICIES["v5"], claims(spark, FEB))
    assert rp.failing_rows(run).collect() == []


def test_rows_without_a_key_fail_together(spark, folder):
    spec = [s for s in default_suite() if s.type == "unique"]
    for rows in (FEB, JAN):
        df = claims(spark, rows).repartition(4)
        run = run_suite(spec, POLICIES["v5"], df, keys=KeyStates(spark, f"{folder}/{len(rows)}", 4).arrive("1", df))
        assert sorted(str(r.claim_number) for r in rp.failing_rows(run).collect()) == \
            sorted(str(r.claim_number) for r in kc.failing_duplicates(df, "claim_number").collect())


def test_layouts_are_elected_whatever_the_order(spark):
    rows = [("13/02/2024", "01/02/2024", "x", 1), ("05/01/2024", "02/03/2024", None, 2), ("2024-01-05", "03/04/2024", "", 3), (None, None, "-", 4),
            (" 29/02/2024 ", "12/12/2024", " ", 5)]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "day string, both string, none string, n int").repartition(n, "n")
        got = [tuple(str(x) for x in r) for r in elect_dates(df, ["day", "both", "none", "absent"]).orderBy("n").collect()]
        assert got == [("2024-02-13 00:00:00", "2024-01-02 00:00:00", "None", "1"), ("2024-01-05 00:00:00", "2024-02-03 00:00:00", "None", "2"),
                       ("None", "2024-03-04 00:00:00", "None", "3"), ("None", "None", "None", "4"), ("2024-02-29 00:00:00", "2024-12-12 00:00:00", "None", "5")]
        told = {r.column: r for r in elected_layouts(df, ["day", "both", "none", "n"]).collect()}
        assert (told["day"].layout, told["day"].votes, told["day"].n_values, told["day"].ambiguous) == ("dd/MM/yyyy", 3, 4, False)
        assert (told["both"].layout, told["both"].runner_up, told["both"].ambiguous) == ("MM/dd/yyyy", "dd/MM/yyyy", True)
        assert (told["none"].layout, told["none"].votes, told["none"].ambiguous, told["none"].n_values) == (None, 0, False, 2)
        assert set(told) == {"day", "both", "none"}
    empty = spark.createDataFrame([], "day string")
    assert elect_dates(empty, ["day"]).collect() == [] and elected_layouts(empty, ["day"]).first().layout is None


def test_election_reads_the_column_once_for_all(spark, folder):
    fx.dates_as_entered(spark, SF).write.parquet(f"{folder}/entered")
    df = elect_dates(spark.read.parquet(f"{folder}/entered"), ["accident_date", "uw_date"])
    df.collect()
    assert plan_text(df).count("Subquery scalar-subquery") - plan_text(df).count("ReusedSubquery") <= 1
    run = run_suite(default_suite(), POLICIES["v5"], df.withColumn("claim_status", F.lit("Open")), as_of_year=2002)
    rates = {r.check_id: r.pass_rate for r in run.checks.collect()}
    assert 0 < rates["5.1"] < 100 and rates["5.2"] < 100


def test_counts_come_from_footers(spark, folder):
    fx.claims_history(spark, SF).write.partitionBy("bdx_month").parquet(f"{folder}/h")
    counts = metadata.snapshot_counts(spark, f"{folder}/h")
    plan = counts._jdf.queryExecution().optimizedPlan().toString() + plan_text(counts)
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [bdx_month]" in plan
    n = {str(r.bdx_month): r.record_count for r in counts.collect()}
    assert n[fx.CURRENT_BDX] == fx.claims_snapshot(spark, SF, True).count() and len(n) == 2
    assert metadata.count_range(spark, f"{folder}/h", fx.PREVIOUS_BDX, fx.CURRENT_BDX).first()[0] == sum(n.values())
    assert metadata.count_range(spark, f"{folder}/h", "2031-01-01", "2031-02-01").first()[0] == 0
    assert "BatchScan" not in plan_text(spark.read.parquet(f"{folder}/h"))       # other reads are as before


def test_file_sets_of_one_layout_share_a_scan(spark, folder):
    for i, cols in enumerate([("Policy Number", "Paid"), ("Policy Number", "Paid"), ("PolNum", "Nothing")]):
        spark.createDataFrame([(f"P{i}", "1.5")], f"`{cols[0]}` string, `{cols[1]}` string").write.parquet(f"{folder}/{i}")
    got = files.read_file_sets(spark, [(f"{folder}/{i}", "parquet") for i in range(3)])
    assert plan_text(got).count("FileScan parquet") == 2
    assert sorted((r.policy_number, r.total_paid) for r in got.collect()) == [("P0", 1.5), ("P1", 1.5), ("P2", None)]


def test_checks_are_counted_by_the_write(spark, folder):
    usual = _run(spark)
    run = run_suite(default_suite(), POLICIES["v5"], fx.claims_snapshot(spark, SF, True), None, None, ["Closed"], 2002, store_to=f"{folder}/s")
    assert sorted(map(str, run.checks.collect())) == sorted(map(str, usual.checks.collect()))
    assert run.total_records().first()[0] == spark.read.parquet(f"{folder}/s").count()
    assert "FileScan" not in plan_text(run.total_records())
    none = run_suite(default_suite(), POLICIES["v5"], fx.claims_snapshot(spark, SF, True).limit(0), as_of_year=2002, store_to=f"{folder}/e")
    assert none.total_records().first()[0] == 0


def test_custom_functions_by_name(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION veracity_positive(a DOUBLE) RETURNS BOOLEAN RETURN a > 0")
    config = {"checks": {"c": {"s": [{"id": str(i), "check_type": "custom", "function": f, "field": "total_paid", "points": 1, "scoring": {1: 1, "default": 0}}
                                     for i, f in enumerate(["veracity_positive", "no_such_function", "bad name("])]}}}
    run = run_suite(specs_from_config(config, 2002), POLICIES["root"], claims(spark, [("a", 1.0), ("b", -1.0), ("c", None)]), as_of_year=2002)
    rows = {r.check_id: r for r in run.checks.collect()}
    assert (rows["0"].total, rows["0"].passed, rows["0"].error) == (2, 1, None)
    assert rows["1"].error and rows["2"].error
    assert "PythonUDF" not in plan_text(run.checks) and "veracity_positive" not in plan_text(run.checks)


def test_a_month_from_arrival_to_stored_run(spark, folder):
    from veracity.plans.arrival import Arrivals
    arrivals = Arrivals(spark, f"{folder}/a", buckets=4)
    feb = fx.claims_snapshot(spark, SF, True)
    for month, quarter, df in (("1998-01", "q1", fx.claims_snapshot(spark, SF, False)), ("1998-02", "q2", feb.limit(10)), ("1998-02", "q2", feb)):
        run = arrivals.receive(month, df, default_suite(), POLICIES["v5"], quarter, "2024-01-01 00:00:00", None, ["Closed"], 2002, f"{folder}/f-{month}")
    usual = run_suite(default_suite(), POLICIES["v5"], feb, fx.claims_snapshot(spark, SF, False), None, ["Closed"], 2002)
    assert sorted(map(str, run.checks.collect())) == sorted(map(str, usual.checks.collect()))
    stored = {r.check_id: r.failed_count for r in arrivals.runs.read("dq_check_results", "q2").collect()}
    assert stored == {r.check_id: r.failed for r in usual.checks.collect()}
    assert [(r.snapshot, r.record_count, r.previous_snapshot) for r in arrivals.snapshots().orderBy("snapshot").collect()] == \
        [("1998-01", fx.claims_snapshot(spark, SF, False).count(), None), ("1998-02", feb.count(), "1998-01")]
    assert arrivals.claims("1998-02").schema == feb.schema and arrivals.claims("1998-02").count() == feb.count()
    assert spark.read.parquet(f"{folder}/f-1998-02").count() == rp.failing_rows(usual).count()
