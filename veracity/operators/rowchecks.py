"""Row-level checks (completeness, ranges, dates, cross-column rules).

Each check is a pair of boolean Columns: ``scope`` (rows counted in the
total) and ``ok`` (rows that pass, read only inside the scope). A suite turns
every row check into two ``count_if`` aggregates of ONE shared ``agg``, so any
number of row checks costs one scan and no shuffle beyond the partial/final
aggregate of a single row.

A check whose column is absent is reported as ``missing`` instead: pass rate 0,
passed 0, failed 0, total = row count (or the scope count where the rule says
so), with the absent column named in ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.functions.coerce import (DATE_COLUMNS, NUMERIC_COLUMNS, STRING_COLUMNS, as_double, as_string,
                                       as_timestamp, double_sql, timestamp_sql)
from veracity.functions.text import CLOSED_MATCHERS


@dataclass(frozen=True)
class RowCheck:
    scope: Column
    ok: Column
    empty_rate: float = 0.0
    missing: str | None = None          # absent column(s): result is a fixed zero row
    missing_scope: Column | None = None  # when set, a missing result's total is count_if(this)
    error: str | None = None            # the check can't be planned: a zero-point row with this text


class Cols:
    """Typed access to the logical columns of a mapped (not yet coerced) frame."""

    def __init__(self, df: DataFrame, coerce: str = "all"):
        self.df = df
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.coerce = coerce

    def has(self, *names: str) -> bool:
        return all(n in self.types for n in names)

    def absent(self, *names: str) -> str | None:
        gone = [n for n in names if n not in self.types]
        return ", ".join(gone) if gone else None

    def raw(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def ts(self, name: str) -> Column:
        return as_timestamp(self.raw(name), self.types[name])

    def num(self, name: str) -> Column:
        return as_double(self.raw(name), self.types[name])

    def value(self, name: str) -> Column:
        """The column as the profile sees it: coerced by its logical name, or raw."""
        if self.coerce == "none":
            return self.raw(name)
        if name in DATE_COLUMNS:
            return self.ts(name)
        if name in NUMERIC_COLUMNS:
            return self.num(name)
        if name in STRING_COLUMNS and self.coerce == "all":
            return as_string(self.raw(name))
        return self.raw(name)

    def value_type(self, name: str) -> T.DataType:
        if self.coerce != "none" and name in DATE_COLUMNS:
            return T.TimestampNTZType()
        if self.coerce != "none" and name in NUMERIC_COLUMNS:
            return T.DoubleType()
        if self.coerce == "all" and name in STRING_COLUMNS:
            return T.StringType()
        return self.types[name]


def _missing(cols: Cols, *names: str, scope: Column | None = None) -> RowCheck | None:
    gone = cols.absent(*names)
    if gone:
        return RowCheck(F.lit(True), F.lit(False), missing=gone, missing_scope=scope)
    return None


def _is_blank(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return ~c.rlike(r"(?U)\S")
    return F.lit(False)


# K1
def not_null(cols: Cols, field: str, blank_fails: bool = True) -> RowCheck:
    """Null fails; with ``blank_fails`` a string of white space only fails too."""
    if (m := _missing(cols, field)):
        return m
    v = cols.value(field)
    ok = v.isNotNull()
    if blank_fails:
        ok = ok & ~F.coalesce(_is_blank(v, cols.value_type(field)), F.lit(False))
    return RowCheck(F.lit(True), ok)


# K2
def not_null_not_year_1900(cols: Cols, field: str) -> RowCheck:
    """Unparsable, null or year-1900 dates fail."""
    if (m := _missing(cols, field)):
        return m
    d = cols.ts(field)
    return RowCheck(F.lit(True), d.isNotNull() & (F.year(d) != 1900))


# K3
def non_negative(cols: Cols, field: str, null_rule: str = "fail") -> RowCheck:
    """``null_rule``: 'fail' (null fails), 'pass' (null passes), 'drop' (nulls leave the denominator)."""
    if (m := _missing(cols, field)):
        return m
    x = cols.num(field)
    if null_rule == "fail":
        return RowCheck(F.lit(True), F.coalesce(x >= 0, F.lit(False)))
    if null_rule == "pass":
        return RowCheck(F.lit(True), x.isNull() | (x >= 0))
    if null_rule == "drop":
        return RowCheck(x.isNotNull(), x >= 0, empty_rate=100.0)
    raise ValueError(f"unknown null_rule {null_rule!r}")


# K4
def non_negative_all(cols: Cols, fields: Sequence[str]) -> RowCheck:
    """Row passes when every present field is null or >= 0; absent fields are skipped."""
    ok = F.lit(True)
    for f in fields:
        if cols.has(f):
            x = cols.num(f)
            ok = ok & (x.isNull() | (x >= 0))
    return RowCheck(F.lit(True), ok)


# K5
def valid_date(cols: Cols, field: str, null_rule: str = "fail") -> RowCheck:
    """Parsable date. 'fail': null is invalid; 'pass': a null raw value passes."""
    if (m := _missing(cols, field)):
        return m
    d = cols.ts(field)
    if null_rule == "fail":
        return RowCheck(F.lit(True), d.isNotNull())
    return RowCheck(F.lit(True), d.isNotNull() | cols.raw(field).isNull())


# K6
def valid_dates_all(cols: Cols, fields: Sequence[str]) -> RowCheck:
    """Every present field parses or is null."""
    ok = F.lit(True)
    for f in fields:
        if cols.has(f):
            ok = ok & (cols.ts(f).isNotNull() | cols.raw(f).isNull())
    return RowCheck(F.lit(True), ok)


# K7
def year_in_range(cols: Cols, field: str, as_of_year: int, span: int = 15) -> RowCheck:
    """Year value within [as_of - span, as_of]; null fails."""
    if (m := _missing(cols, field)):
        return m
    y = cols.num(field)
    return RowCheck(F.lit(True), F.coalesce(y.between(as_of_year - span, as_of_year), F.lit(False)))


def value_range(cols: Cols, field: str, low: float | None, high: float | None) -> RowCheck:
    """low <= value <= high (either bound optional); null fails."""
    if (m := _missing(cols, field)):
        return m
    x = cols.num(field)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= float(low))
    if high is not None:
        ok = ok & (x <= float(high))
    return RowCheck(F.lit(True), F.coalesce(ok, F.lit(False)))


def values_in_range_all(cols: Cols, fields: Sequence[str], low: float | None, high: float | None) -> RowCheck:
    """Every present field is null or within [low, high]; absent fields are skipped."""
    ok = F.lit(True)
    for f in fields:
        if cols.has(f):
            x = cols.num(f)
            inside = F.lit(True)
            if low is not None:
                inside = inside & (x >= float(low))
            if high is not None:
                inside = inside & (x <= float(high))
            ok = ok & (x.isNull() | inside)
    return RowCheck(F.lit(True), ok)


# K8
def closed_os_zero(cols: Cols, status_field: str, os_field: str, closed_values: Sequence[object],
                   match: str = "word", os_null: str = "fail") -> RowCheck:
    """Closed rows must carry zero outstanding. Scope = closed rows; an empty scope passes (100 %).

    ``match``: word | substring | exact | case_sensitive. ``os_null``: 'fail' or 'pass' (null read as 0).
    """
    if (m := _missing(cols, status_field, os_field)):
        return m
    status = cols.raw(status_field).cast("string")
    scope = CLOSED_MATCHERS[match](status, closed_values)
    os_ = cols.num(os_field)
    ok = F.coalesce(os_ == 0, F.lit(False)) if os_null == "fail" else (F.coalesce(os_, F.lit(0.0)) == 0)
    return RowCheck(scope, ok, empty_rate=100.0)


def _plus_one_year(d: Column) -> Column:
    # keeps the time of day; 29 Feb + 1 year = 28 Feb
    return d + F.make_ym_interval(F.lit(1), F.lit(0))


# K9
def loss_within_policy(cols: Cols, loss: str = "accident_date", start: str = "policy_start_date",
                       end: str = "policy_end_date", rule: str = "v5") -> RowCheck:
    """Loss date inside [start, end], inclusive.

    rule 'v5': scope = loss not null; null start or end fails; absent end = start + 1 year.
    rule 'row_fallback': scope = loss, start, end(after fallback) not null; null end = start + 1 year per row.
    rule 'no_fallback': scope = all three not null; absent end = start + 1 year.
    rule 'drop_empty_full': as 'no_fallback' but an empty scope passes (100 %).
    """
    if rule == "v5":
        if (m := _missing(cols, loss)):
            return m
        ld = cols.ts(loss)
        if (m := _missing(cols, start, scope=ld.isNotNull())):
            return m
        sd = cols.ts(start)
        ed = cols.ts(end) if cols.has(end) else _plus_one_year(sd)
        return RowCheck(ld.isNotNull(), F.coalesce((ld >= sd) & (ld <= ed), F.lit(False)))
    if (m := _missing(cols, loss, start)):
        return m
    ld, sd = cols.ts(loss), cols.ts(start)
    if cols.has(end):
        ed = cols.ts(end)
        if rule == "row_fallback":
            ed = F.coalesce(ed, _plus_one_year(sd))
    else:
        ed = _plus_one_year(sd)
    scope = ld.isNotNull() & sd.isNotNull() & ed.isNotNull()
    empty = 100.0 if rule == "drop_empty_full" else 0.0
    return RowCheck(scope, (ld >= sd) & (ld <= ed), empty_rate=empty)


# K10
def sum_within_tolerance(cols: Cols, total: str, part_a: str, part_b: str, tolerance: float,
                         empty_rate: float = 0.0) -> RowCheck:
    """|total - (a + b)| <= tolerance; scope = all three not null."""
    if (m := _missing(cols, total, part_a, part_b)):
        return m
    t, a, b = cols.num(total), cols.num(part_a), cols.num(part_b)
    scope = t.isNotNull() & a.isNotNull() & b.isNotNull()
    return RowCheck(scope, F.abs(t - (a + b)) <= F.lit(float(tolerance)), empty_rate=empty_rate)


# K11
def net_within_gross(cols: Cols, net_paid: str = "net_paid", gross_paid: str = "gross_paid",
                     net_incurred: str = "net_incurred", gross_incurred: str = "gross_incurred") -> RowCheck:
    """net <= gross on both pairs; scope = all four not null."""
    if (m := _missing(cols, net_paid, gross_paid, net_incurred, gross_incurred)):
        return m
    np_, gp, ni, gi = (cols.num(c) for c in (net_paid, gross_paid, net_incurred, gross_incurred))
    scope = np_.isNotNull() & gp.isNotNull() & ni.isNotNull() & gi.isNotNull()
    return RowCheck(scope, (np_ <= gp) & (ni <= gi))


# K12
def date_not_after(cols: Cols, first: str, second: str) -> RowCheck:
    """first <= second; scope = both not null."""
    if (m := _missing(cols, first, second)):
        return m
    a, b = cols.ts(first), cols.ts(second)
    return RowCheck(a.isNotNull() & b.isNotNull(), a <= b)


# K13
def year_matches_date(cols: Cols, year_field: str, date_field: str) -> RowCheck:
    """year value == year(date); scope = both not null."""
    if (m := _missing(cols, year_field, date_field)):
        return m
    y, d = cols.num(year_field), cols.ts(date_field)
    return RowCheck(y.isNotNull() & d.isNotNull(), y == F.year(d))


# K14
def expression(cols: Cols, predicate: str, scope: str | None = None, empty_rate: float = 0.0,
               value_kind: str | None = None) -> RowCheck:
    """A declared SQL predicate (e.g. ``abs(a - (b + c)) <= 1``); null counts as a failure.

    Columns are read coerced: as the profile reads them, or all as numbers or dates with
    ``value_kind``, so text columns compare by value and unparsable values are null. A zero divisor
    gives null.
    """
    def over(text: str) -> Column:
        return F.expr(_null_on_zero(_coerced_names(cols, text, value_kind)))
    sc = F.coalesce(over(scope), F.lit(False)) if scope else F.lit(True)
    return RowCheck(sc, F.coalesce(over(predicate), F.lit(False)), empty_rate=empty_rate)


_NAME = re.compile(r"'(?:[^']|'')*'|`[^`]+`|[A-Za-z_]\w*")


def _coerced_names(cols: Cols, text: str, kind: str | None) -> str:
    """The predicate's text with each column name replaced by its coerced form."""
    def one(m: re.Match) -> str:
        name = m[0].strip("`")
        if m[0][0] == "'" or name not in cols.types:
            return m[0]
        dtype, quoted = cols.types[name], f"`{name}`"
        if kind == "number" or kind is None and cols.coerce != "none" and name in NUMERIC_COLUMNS:
            return double_sql(quoted, dtype)
        if kind == "date" or kind is None and cols.coerce != "none" and name in DATE_COLUMNS:
            return timestamp_sql(quoted, dtype)
        return quoted
    return _NAME.sub(one, text)


def _null_on_zero(text: str) -> str:
    """Divisors that are a name, a number or a bracket, wrapped so that zero gives null."""
    out, at = [], 0
    while (k := text.find("/", at)) >= 0:
        start = k + 1 + len(text[k + 1:]) - len(text[k + 1:].lstrip())
        end, depth = start, 0
        while end < len(text) and (depth or text[end] == "(" or text[end].isalnum() or text[end] in "_.`"):
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        out += [text[at:k], "/ nullif(", _null_on_zero(text[start:end]), ", 0)"]
        at = end
    return "".join(out) + text[at:]
