"""Registered queries against their DuckDB oracle SQL (sf0.001; all queries with VERACITY_FULL_ORACLE=1)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ["suite_v5", "suite_v2", "suite_root", "j_paid_inner", "k_closed_word", "premium_totals", "snap_previous",
         "dq_scores_row", "report_detail", "score_trend", "coerce_types", "map_shared_column", "results_json",
         "report_risk", "suite_by_snapshot", "suite_root_declared", "failed_records_json"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("VERACITY_FULL_ORACLE") else QUICK


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "points_earned" in df.columns


def test_every_query_has_a_runnable_plan(spark):
    for name, fn in E.queries().items():
        assert fn(spark, SF).schema is not None, name
