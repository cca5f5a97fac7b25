"""Report export, snapshot discovery and column matching."""
import os
import tempfile

from veracity.catalog import v5_run
from veracity.operators.mapping import apply_mapping, auto_match, best_match
from veracity.plans import reports as rp
from veracity.sources.snapshots import snapshot_column

SF = "/root/testdata/sf0.001"


def test_snapshot_column_discovery():
    assert snapshot_column(["id", "Bdx_Month_x", "bdx_month"]) == "Bdx_Month_x"
    assert snapshot_column(["id", "value"]) == "bdx_month"
    assert snapshot_column(["id", "evaluation_date"], "list") == "evaluation_date"
    assert snapshot_column(["id", "BDX_MONTH", "bdx_month"], "list") == "bdx_month"
    assert snapshot_column(["id", "load_date"], "file") == "load_date"


def test_auto_match_and_best_match(spark):
    cols = ["Claim Number", "Policy_Number", "Date of Loss", "Status", "Paid", "OS", "Total Paid"]
    m = auto_match(cols, preselected={"total_paid": "Paid"})
    assert m["claim_number"] == "Claim Number" and m["policy_number"] == "Policy_Number"
    assert m["accident_date"] == "Date of Loss" and m["claim_status"] == "Status"
    assert m["total_paid"] == "Paid"                     # preselection wins over the alias order
    assert m["total_os"] == "OS"
    assert best_match(["Bldg Prem", "Contents Premium"], ["building prem", "bldg"]) == "Bldg Prem"
    assert best_match(["x"], ["y"]) == ""
    df = spark.createDataFrame([(1, "a")], "`Claim Number` int, other string")
    out = apply_mapping(df, {"claim_number": "Claim Number", "claim_id": "Claim Number", "gone": "nope"})
    assert sorted(out.columns) == ["claim_id", "claim_number", "other"]


def test_write_reports_and_failures(spark):
    run = v5_run(spark, SF)
    root = tempfile.mkdtemp(prefix="run-reports-", dir="/tmp")
    rp.write_reports(run, os.path.join(root, "report"), "1998_Q1")
    for t in ("summary", "category_scores", "detailed_results", "failed_checks"):
        assert spark.read.parquet(os.path.join(root, "report", t)).count() > 0
    ids = rp.write_failures(run, os.path.join(root, "errors"), fmt="csv")
    assert "3.1" in ids and "6.1" in ids
    missing = spark.read.option("header", True).csv(os.path.join(root, "errors", "check_6.1"))
    assert missing.columns == ["Missing Claim Number"]


def test_file_source_with_text_snapshots(spark):
    from pyspark.sql import functions as F

    from veracity.plans.spec import POLICIES, default_suite
    from veracity.plans.suite import run_suite
    from veracity.sources import files
    from veracity.sources import fixtures as fx
    root = tempfile.mkdtemp(prefix="run-files-", dir="/tmp")
    hist = fx.claims_history(spark, SF).withColumn("bdx_month", F.date_format("bdx_month", "yyyy-MM-dd"))
    hist.write.option("header", True).csv(os.path.join(root, "claims"))
    raw = files.read_files(spark, os.path.join(root, "claims"), "csv")
    assert [str(r[0]) for r in files.list_file_snapshots(raw, "bdx_month").collect()] == \
        ["1998-01-01 00:00:00", "1998-02-01 00:00:00"]
    cur = files.load_file_snapshot(raw, "1998-02-01", "bdx_month")
    assert cur.count() == fx.claims_snapshot(spark, SF, True).count()
    # text columns are coerced by the suite exactly like typed ones
    typed = run_suite(default_suite(), POLICIES["v5"], fx.claims_snapshot(spark, SF, True)).checks
    text = run_suite(default_suite(), POLICIES["v5"], cur.drop("bdx_month")).checks
    pick = ["check_id", "total", "passed", "failed"]
    assert sorted(map(tuple, typed.select(*pick).collect())) == sorted(map(tuple, text.select(*pick).collect()))
