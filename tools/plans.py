"""Print the physical plans of the flagship suite over stored, snapshot-partitioned claims.

usage: python tools/plans.py [sf_dir]
"""
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veracity.operators import keychecks as kc  # noqa: E402
from veracity.plans.spec import POLICIES, default_suite  # noqa: E402
from veracity.plans.suite import run_suite  # noqa: E402
from veracity.session import get_spark  # noqa: E402
from veracity.sources import fixtures as fx  # noqa: E402
from veracity.sources import snapshots as sn  # noqa: E402

NOISE = re.compile(r"#\d+L?|\[plan_id=\d+\]|, Location: [^,\]]+\]|Batched: true, |Format: Parquet, ")


def tree(df, width=150):
    df.write.format("noop").mode("overwrite").save()          # final (adaptive) plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        line = NOISE.sub("", line)
        if re.search(r"(Project|ColumnarToRow|InputAdapter|WholeStageCodegen|ShuffleQueryStage|AQEShuffleRead|"
                     r"BroadcastQueryStage|Sort \[)", line):
            continue
        out.append(line[:width])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    root = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp")
    fx.claims_history(spark, sf).write.partitionBy("bdx_month").parquet(f"{root}/claims")
    fx.risk_table(spark, sf).write.parquet(f"{root}/risk")
    claims, risk = spark.read.parquet(f"{root}/claims"), spark.read.parquet(f"{root}/risk")
    cur = sn.load_snapshot(claims, fx.CURRENT_BDX, "bdx_month")
    prev = sn.load_snapshot(claims, fx.PREVIOUS_BDX, "bdx_month")
    run = run_suite(default_suite(include_risk=True), POLICIES["v5"], cur, prev, risk, ["Closed"], 2002)
    print("== canonical suite ==")
    print(tree(run.checks))
    print("\n== pairwise paid check ==")
    print(tree(kc.paid_not_decreasing_rows(cur, prev, "claim_number", "total_paid")))
    from veracity.plans.history import run_suite_by_snapshot
    print("\n== every snapshot in one job ==")
    print(tree(run_suite_by_snapshot(default_suite(), POLICIES["v5"], claims, "bdx_month", None, ["Closed"], 2002)))


if __name__ == "__main__":
    main()
