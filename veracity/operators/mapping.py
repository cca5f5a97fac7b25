"""Column mapping: physical column names to logical names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Physical-name aliases tried in order for each logical claims column.
CLAIMS_ALIASES = {
    "policy_number": ["Policy Number", "Policy_Number", "PolicyNumber", "Policy_Num", "PolNum"],
    "claim_number": ["Claim Number", "Claim_Number", "ClaimNumber", "Claim_Num", "ClmNum"],
    "accident_date": ["Accident Date", "Accident_Date", "AccidentDate", "Date of Loss", "Loss Date", "DOL"],
    "claim_status": ["Status of Claim", "Claim Status", "claim_status", "Status", "ClaimStatus"],
    "uw_date": ["UW Date", "Policy Inception Date", "Policy Start Date", "Inception Date", "UW_Date"],
    "policy_start_date": ["Policy Start Date", "Policy_Start_Date", "Inception Date", "Start Date"],
    "policy_end_date": ["Policy End Date", "Policy_End_Date", "End Date", "Expiry Date"],
    "total_incurred": ["Total Incurred", "Total_Incurred", "Incurred", "Incurred Amount"],
    "total_paid": ["Total Paid", "Total_Paid", "Paid", "Paid Amount"],
    "total_os": ["Total OS", "Total Outstanding", "Total Reserve", "Total Estimate", "Outstanding", "Reserve", "OS"],
    "policy": ["Policy Number", "Policy_Number", "PolicyNumber"],
}

# Physical-name aliases of the gross/net suite's logical columns.
GROSS_NET_ALIASES = {
    "policy_number": ["Policy Number", "Policy_Number", "PolicyNumber", "policy_number"],
    "claim_number": ["Claim Number", "Claim_Number", "ClaimNumber", "claim_number"],
    "accident_date": ["Accident Date", "Accident_Date", "Date of Loss", "accident_date"],
    "accident_year": ["Accident Year", "Accident_Year", "AY", "accident_year"],
    "notification_date": ["Notification Date", "Notification_Date", "Reported Date", "notification_date"],
    "gross_paid": ["Gross Paid", "Gross_Paid", "gross_paid"],
    "gross_estimate": ["Gross Estimate", "Gross_Estimate", "Gross Reserve", "gross_estimate"],
    "gross_incurred": ["Gross Incurred", "Gross_Incurred", "gross_incurred"],
    "net_paid": ["Net Paid", "Net_Paid", "net_paid"],
    "net_incurred": ["Net Incurred", "Net_Incurred", "net_incurred"],
    "risk_policy_number": ["Policy Number", "Policy_Number", "PolicyNumber", "risk_policy_number"],
    "gwp": ["GWP", "Gross Written Premium", "Gross_Written_Premium", "gwp"],
}

# Case-insensitive substrings tried in order for each premium input.
PREMIUM_CANDIDATES = {
    "postcode": ["postcode", "post_code", "postal"],
    "address": ["address", "addr"],
    "flood_score": ["flood score", "flood_score", "floodscore"],
    "theft": ["theft"],
    "subsidence": ["subsidence", "subsid"],
    "building_prem": ["building prem", "building_prem", "bldg"],
    "contents_prem": ["contents prem", "contents_prem", "cont"],
    "flood_loading": ["flood loading", "flood_loading"],
    "theft_loading": ["theft loading", "theft_loading"],
    "subsidence_loading": ["subsidence loading", "subsidence_load"],
}


# P1 / P2
def apply_mapping(df: DataFrame, mapping: Mapping[str, str], keep_unmapped: bool = True) -> DataFrame:
    """One projection: each mapped physical column under its logical name. Two logical names on
    one physical column both receive the data. Mappings to absent columns are skipped."""
    present = {lg: ph for lg, ph in mapping.items() if ph and ph in df.columns}
    mapped = [F.col(f"`{ph}`").alias(lg) for lg, ph in present.items()]
    used = set(present.values()) | set(present.keys())
    rest = [F.col(f"`{c}`") for c in df.columns if keep_unmapped and c not in used]
    return df.select(*mapped, *rest)


# P3
def auto_match(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = CLAIMS_ALIASES,
               preselected: Mapping[str, str] | None = None) -> dict[str, str]:
    """Logical -> physical by exact alias, in alias order; a preselected physical name wins if present."""
    preselected = preselected or {}
    out = {}
    for logical, options in aliases.items():
        pick = preselected.get(logical)
        if pick and pick in columns:
            out[logical] = pick
            continue
        hit = next((o for o in options if o in columns), None)
        if hit:
            out[logical] = hit
    return out


# P4
def best_match(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """First column containing a candidate (case-insensitive), candidate order first; '' if none."""
    for cand in candidates:
        for col in columns:
            if cand.lower() in col.lower():
                return col
    return ""


def premium_mapping(columns: Sequence[str]) -> dict[str, str]:
    return {k: best_match(columns, v) for k, v in PREMIUM_CANDIDATES.items()}
