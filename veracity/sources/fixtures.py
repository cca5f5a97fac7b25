"""Claims-shaped inputs derived from the TPC-H-style test tables.

The checks need an insurance-claims table, its previous snapshot, a reference
(risk) table, premium rating inputs and raw date text. These views derive them
from ``lineitem``/``orders``/``customer``/``part`` with planted defects, so every
query's work grows with the given tables. The same definitions, in DuckDB SQL,
back the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.sources.tables import read_table

# The two claim snapshots.
CURRENT_BDX = "1998-02-01 00:00:00"
PREVIOUS_BDX = "1998-01-01 00:00:00"


# Rows of ``lineitem`` that one task takes, with their orders and claim keys.
LINES_A_TASK = 1_000_000


def claim_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the claims and for groupings of their keys: the session's shuffle partitions or, where those would give a
    task more than ``LINES_A_TASK`` lines, as many as the lines need. The count reads the files' footers alone."""
    lines = read_table(spark, sf_dir, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-lines // LINES_A_TASK))


def _with_orders(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """``lines`` with the order of each. An order has few columns and several lines, so tasks hold the orders of their
    partition in a hash table, which can't spill, and don't sort the lines. Lines are narrow and compress well: partitions merged
    by their size in bytes would give a task many orders and, in the same task, many claim keys, so all partitions stay apart,
    and there are more of them as the lines grow."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.repartition(claim_parts(spark, sf_dir), "l_orderkey").join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))


# Each view is one projection written as SQL text: the JVM parses it once, instead of Python building
# every CASE branch through the gateway. What follows from a line alone is projected before the join with
# its order, so the shuffle moves flags instead of part and supplier keys.
_LINES_SELECT = [
    "l_orderkey", "l_linenumber", "l_quantity",
    "l_suppkey % 50 = 0 AS renumbered", "l_partkey % 40 = 0 AS halved",
    "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_shipdate END AS accident_date",
    "CASE l_returnflag WHEN 'R' THEN ' Closed ' WHEN 'A' THEN 'RE-CLOSED' ELSE CASE WHEN l_suppkey % 7 = 0 THEN NULL "
    "WHEN l_suppkey % 5 = 0 THEN 'Disclosed' ELSE 'Open' END END AS claim_status",
    "CASE WHEN l_partkey % 89 = 0 THEN 1 WHEN l_partkey % 83 = 0 THEN 2 ELSE 0 END AS uw_case",
    "l_suppkey % 11 = 0 AS endless", "l_partkey % 79 = 0 AS negative", "l_suppkey % 13 = 0 AS raised",
    "CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END AS estimate",
    "CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS DOUBLE) WHEN l_partkey % 71 = 0 THEN NULL "
    "WHEN l_partkey % 73 = 0 THEN 3.0D ELSE 0.0D END AS total_os",
]
_MARK = "CASE WHEN renumbered THEN 'R' ELSE 'C' END"
_PAID = "CASE WHEN halved THEN 0.5D ELSE 1.0D END * l_quantity"
_CLAIMS_SELECT = [
    "CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN '  ' "
    "ELSE concat('P', CAST(o_custkey AS STRING)) END AS policy_number",
    "CASE WHEN l_orderkey % 211 = 0 THEN NULL "
    "ELSE concat({mark}, CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS claim_number",
    "accident_date", "claim_status",
    "CASE uw_case WHEN 1 THEN TIMESTAMP_NTZ '1900-01-01 00:00:00' WHEN 2 THEN NULL ELSE o_orderdate END AS uw_date",
    "o_orderdate AS policy_start_date",
    "CASE WHEN endless THEN NULL ELSE o_orderdate + INTERVAL '1' YEAR END AS policy_end_date",
    "CAST(CASE WHEN negative THEN -1.0D ELSE {paid} + estimate + CASE WHEN raised THEN 7.5D ELSE 0.0D END END AS DOUBLE) "
    "AS total_incurred",
    "CAST({paid} AS DOUBLE) AS total_paid", "total_os",
]


def _claim_lines(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return _with_orders(spark, sf_dir, (li.where(where) if where else li).selectExpr(*_LINES_SELECT))


def claims_snapshot(spark: SparkSession, sf_dir: str, current: bool = True) -> DataFrame:
    """One monthly claims snapshot. The current one is all of ``lineitem``; the previous one lacks the
    orders whose key is divisible by 37 (claims new this month). Claims of suppliers divisible by 50
    were renumbered since, so their old numbers are missing from the current snapshot."""
    mark, paid = (_MARK, _PAID) if current else ("'C'", "l_quantity")
    lines = _claim_lines(spark, sf_dir, None if current else "l_orderkey % 37 <> 0")
    return lines.selectExpr(*[e.format(paid=paid, mark=mark) for e in _CLAIMS_SELECT])


def claims_text(spark: SparkSession, sf_dir: str, current: bool = True) -> DataFrame:
    """A claims snapshot with every column as text, as files without a schema give it: unparsable
    dates and numbers, tabs and line ends, amounts in tenths."""
    day, second = "'yyyy-MM-dd'", "'yyyy-MM-dd HH:mm:ss'"
    return claims_snapshot(spark, sf_dir, current).selectExpr(
        "CASE WHEN policy_number = '  ' THEN '\\t\\n' ELSE policy_number END AS policy_number", "claim_number",
        f"CASE WHEN total_paid = 13 THEN 'bad' WHEN total_paid = 17 THEN '31/31/1999' "
        f"ELSE date_format(accident_date, {second}) END AS accident_date",
        "CASE WHEN claim_status = ' Closed ' THEN '\\tClosed\\n' ELSE claim_status END AS claim_status",
        f"date_format(uw_date, {day}) AS uw_date", f"date_format(policy_start_date, {second}) AS policy_start_date",
        f"date_format(policy_end_date, {second}) AS policy_end_date",
        "CAST(total_incurred + 0.1D AS STRING) AS total_incurred",
        "CASE WHEN total_paid = 23 THEN 'n/a' ELSE CAST(total_paid + 0.1D AS STRING) END AS total_paid",
        "CASE WHEN total_os = 3 THEN '' ELSE CAST(total_os AS STRING) END AS total_os")


def claims_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots in one table with a ``bdx_month`` snapshot column. Lines and orders are joined once; each
    joined row gives its claim in every snapshot that has it."""
    lines = _claim_lines(spark, sf_dir).withColumn("current", F.explode(F.array(F.lit(False), F.lit(True)))) \
        .where("current OR l_orderkey % 37 <> 0")
    mark, paid = f"IF(current, {_MARK}, 'C')", f"IF(current, {_PAID}, l_quantity)"
    return lines.selectExpr(*[e.format(paid=paid, mark=mark) for e in _CLAIMS_SELECT],
                            f"CAST(IF(current, '{CURRENT_BDX}', '{PREVIOUS_BDX}') AS TIMESTAMP_NTZ) AS bdx_month")


def claims_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross/net claims for the fixed root suite."""
    j = _with_orders(spark, sf_dir, read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_shipdate"))
    return j.selectExpr(
        "CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE concat('P', CAST(o_custkey AS STRING)) END AS policy_number",
        "concat('C', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS claim_number",
        "CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE l_shipdate END AS accident_date",
        "CAST(CASE WHEN l_partkey % 53 = 0 THEN 1970 WHEN l_partkey % 59 = 0 THEN NULL ELSE year(l_shipdate) END "
        "AS INT) AS accident_year",
        "o_orderdate + INTERVAL '365' DAY AS notification_date",
        "l_quantity * 10 AS gross_paid",
        "l_tax * 1000 AS gross_estimate",
        "l_quantity * 10 + l_tax * 1000 + CASE WHEN l_suppkey % 13 = 0 THEN 2.5D ELSE 0.0D END AS gross_incurred",
        "CASE WHEN l_partkey % 67 = 0 THEN l_quantity * 10 + 1 WHEN l_partkey % 71 = 0 THEN -1.0D "
        "ELSE l_quantity * 10 * (1 - l_discount) END AS net_paid",
        "CASE WHEN l_partkey % 73 = 0 THEN NULL ELSE l_quantity * 10 END AS net_incurred",
    )


def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference policies (customers with a non-negative balance) and their written premium."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").where("c_acctbal >= 0")
    return c.selectExpr("concat('P', CAST(c_custkey AS STRING)) AS risk_policy_number",
                        "CASE WHEN c_custkey % 17 = 0 THEN 0.0D ELSE c_acctbal * 5 END AS gwp")


def premium_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property rating inputs, one row per part; building premium arrives as text."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return p.selectExpr(
        "concat('PC', CAST(p_size AS STRING)) AS postcode",
        "concat(p_brand, ' ', CAST(p_partkey AS STRING)) AS address",
        "CAST(p_partkey % 10 AS DOUBLE) AS flood_score",
        "CAST(p_partkey % 9 AS DOUBLE) AS theft",
        "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(p_partkey % 12 AS DOUBLE) END AS subsidence",
        "CASE WHEN p_partkey % 37 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS STRING) END AS building_prem",
        "p_retailprice / 4 AS contents_prem",
        "1 + CAST(p_partkey % 7 AS DOUBLE) / 10 AS flood_loading",
        "1 + CAST(p_partkey % 5 AS DOUBLE) / 20 AS theft_loading",
        "1 + CAST(p_partkey % 3 AS DOUBLE) / 8 AS subsidence_loading",
    )


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim dates as raw text with unparsable, empty and null values."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return li.selectExpr(
        "concat('C', CAST(l_orderkey AS STRING)) AS claim_number",
        "CASE WHEN l_partkey % 61 = 0 THEN 'bad' WHEN l_partkey % 47 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN '' "
        "ELSE date_format(l_shipdate, 'yyyy-MM-dd') END AS accident_date_raw",
        "CASE WHEN l_orderkey % 29 = 0 THEN '2024-13-45' WHEN l_orderkey % 31 = 0 THEN NULL "
        "ELSE date_format(l_shipdate, 'MM/dd/yyyy') END AS notification_raw",
    )


def dates_as_entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim dates as people type them: day-first with some ISO, month-first with some day-first, a column whose days
    are all below 13, ISO with time, and one that holds no date."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.selectExpr(
        "concat('C', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS claim_number",
        "CASE WHEN l_partkey % 61 = 0 THEN 'bad' WHEN l_partkey % 47 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN ' ' "
        "WHEN l_partkey % 5 = 0 THEN date_format(l_shipdate, 'yyyy-MM-dd') ELSE date_format(l_shipdate, 'dd/MM/yyyy') END AS accident_date",
        "CASE WHEN l_suppkey % 4 = 0 THEN date_format(l_shipdate, 'dd/MM/yyyy') "
        "ELSE concat(' ', date_format(l_shipdate, 'MM/dd/yyyy')) END AS uw_date",
        "date_format(date_trunc('MONTH', l_shipdate) + make_interval(0, 0, 0, CAST(l_linenumber AS INT)), 'dd/MM/yyyy') AS policy_start_date",
        "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') AS policy_end_date",
        "CASE WHEN l_partkey % 2 = 0 THEN 'soon' END AS bdx_month")
