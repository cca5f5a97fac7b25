"""Suites from configuration dictionaries (as loaded from YAML).

Two layouts are accepted:

* a flat list ``{"checks": [{"id", "name", "type", "field", "category", "subcategory", "points",
  "enabled", "tolerance", ...}]}``;
* the nested layout ``{"checks": {category: {subcategory: [{"id", "name", "check_type", ...,
  "scoring": {98: 3, 95: 2, "default": 0}}]}}}`` whose declarative check types are translated:
  ``formula`` ("a = b + c" within a tolerance) and ``comparison`` / ``date_comparison``
  ("a <= b") become SQL predicates that Spark's parser evaluates; ``range`` becomes a range check
  whose bounds may say ``current_year - 15``; ``duplicates``, ``date_format`` and ``not_null`` map to the
  built-in checks. A ``custom`` check names a function: a built-in check, or a SQL function registered in the
  session (``CREATE TEMPORARY FUNCTION``), called with the check's ``fields`` and inlined by the optimiser.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from veracity.plans.spec import CheckSpec

# Words that are not column names inside declared predicates.
_SQL_WORDS = {"and", "or", "not", "is", "null", "abs", "between", "current_year", "true", "false"}
# Declared custom functions and the check each one stands for.
_CUSTOM = {"check_ay_matches_date": ("year_matches_date", ("accident_year", "accident_date"))}


def _columns(text: str) -> tuple[str, ...]:
    names = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)
    return tuple(dict.fromkeys(n for n in names if n.lower() not in _SQL_WORDS))


def _bound(v, as_of_year: int) -> float | None:
    if v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    m = re.fullmatch(r"\s*current_year\s*(?:([+-])\s*(\d+))?\s*", str(v))
    if not m:
        return float(v)
    off = int(m.group(2) or 0) * (-1 if m.group(1) == "-" else 1)
    return float(as_of_year + off)


def _thresholds(scoring: Mapping) -> tuple[tuple[float, float], ...]:
    return tuple((float(k), float(v)) for k, v in scoring.items() if k != "default")


def declared_spec(c: Mapping, category: str, subcategory: str, as_of_year: int) -> CheckSpec:
    """One nested-layout check as a CheckSpec."""
    t = c.get("check_type")
    base = dict(id=str(c["id"]), name=str(c.get("name", c["id"])), category=category, subcategory=subcategory,
                points=float(c.get("points", 0)), priority=str(c.get("priority", "medium")),
                thresholds=_thresholds(c.get("scoring", {})), enabled=bool(c.get("enabled", True)))
    if t == "formula":
        lhs, rhs = c["formula"].split("=", 1)
        tol = float(c.get("tolerance", 0))
        return CheckSpec(type="expression", predicate=f"abs(({lhs.strip()}) - ({rhs.strip()})) <= {tol!r}",
                         fields=_columns(c["formula"]), tolerance=tol, value_kind="number", **base)
    if t in ("comparison", "date_comparison"):
        preds = c.get("comparisons") or [c["comparison"]]
        return CheckSpec(type="expression", predicate=" and ".join(f"({p})" for p in preds),
                         fields=_columns(" ".join(preds)),
                         value_kind="date" if t == "date_comparison" else "number", **base)
    if t == "range":
        bounds = (_bound(c.get("min_value"), as_of_year), _bound(c.get("max_value"), as_of_year))
        if c.get("fields"):
            return CheckSpec(type="range", fields=tuple(c["fields"]), bounds=bounds, **base)
        return CheckSpec(type="range", field=c["field"], bounds=bounds, **base)
    if t == "duplicates":
        return CheckSpec(type="unique", field=c.get("field", "claim_number"), **base)
    if t == "date_format":
        return CheckSpec(type="valid_dates_all", fields=tuple(c["fields"]), **base)
    if t == "not_null":
        return CheckSpec(type="not_null", field=c["field"], **base)
    if t == "custom" and c.get("function") in _CUSTOM:
        kind, fields = _CUSTOM[c["function"]]
        return CheckSpec(type=kind, fields=fields, **base)
    if t == "custom" and re.fullmatch(r"[A-Za-z_]\w*(\.\w+){0,2}", str(c.get("function", ""))):
        fields = tuple(c.get("fields") or ([c["field"]] if c.get("field") else ()))
        args = ", ".join(f"`{f}`" for f in fields)
        return CheckSpec(type="expression", predicate=f"{c['function']}({args})", fields=fields,
                         scope=None if c.get("skip_nulls", True) else "true", value_kind=c.get("values"), **base)
    if t == "reconciliation":
        return CheckSpec(type="loss_ratio", **base)
    return CheckSpec(type=str(t), **base)


# The keys of a flat check that rename its columns, with their defaults.
_FIELD_KEYS = {
    "closed_os_zero": (("status_field", "claim_status"), ("os_field", "total_os")),
    "loss_within_policy": (("loss_field", "accident_date"), ("start_field", "policy_start_date"),
                           ("end_field", "policy_end_date")),
    "incurred_equals_paid_plus_os": (("incurred_field", "total_incurred"), ("paid_field", "total_paid"),
                                     ("os_field", "total_os")),
}


def flat_spec(c: Mapping) -> CheckSpec:
    """One check of the flat layout, with its own columns, closed values and pass-rate limits."""
    kind = str(c.get("type", ""))
    fields: tuple[str, ...] = ()
    if any(k in c for k, _ in _FIELD_KEYS.get(kind, ())):
        fields = tuple(str(c.get(k) or default) for k, default in _FIELD_KEYS[kind])
    closed = c.get("closed_status_values")
    limits = {k: float(c[k]) for k in ("high_pass_rate", "mid_pass_rate", "mid_points_factor") if c.get(k) is not None}
    return CheckSpec(
        id=str(c.get("id", "")), name=str(c.get("name", c.get("id", ""))), type=kind,
        category=c.get("category", "checks"), subcategory=c.get("subcategory", "general"),
        points=float(c.get("points", 0)), field=c.get("field"), fields=fields, enabled=bool(c.get("enabled", True)),
        tolerance=c.get("tolerance"), priority=str(c.get("priority", "medium")), risk_key=c.get("risk_policy_col"),
        key=c.get("policy_field") if kind == "risk_policy_match" else c.get("claim_field"), paid=c.get("paid_field"),
        closed_values=tuple(map(str, closed)) if closed else None, **limits)


def specs_from_config(config: Mapping, as_of_year: int) -> list[CheckSpec]:
    checks = config.get("checks", config.get("validation_checks", []))
    if isinstance(checks, list):
        out = []
        return [flat_spec(c) for c in checks]
    out = []
    for category, subs in checks.items():
        for subcategory, items in subs.items():
            out.extend(declared_spec(c, category, subcategory, as_of_year) for c in items)
    return out
