"""String helpers: closed-status matching, labels and display formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean_terms(values: Sequence[object], case: str | None) -> list[str]:
    terms = []
    for v in values:
        if v is None:
            continue
        t = str(v).strip()
        if case == "upper":
            t = t.upper()
        elif case == "lower":
            t = t.lower()
        if t:
            terms.append(t)
    return terms


def strip(c: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def closed_word(status: Column, closed_values: Sequence[object]) -> Column:
    """Whole-word match on upper(trim(status)); 'RE-CLOSED' matches CLOSED, 'DISCLOSED' does not."""
    terms = _clean_terms(closed_values, "upper")
    if not terms:
        return F.lit(False)
    pattern = "|".join(r"\b" + re.escape(t) + r"\b" for t in terms)
    return F.coalesce(F.upper(strip(status)).rlike(pattern), F.lit(False))


def closed_substring(status: Column, closed_values: Sequence[object]) -> Column:
    """Substring match on lower(trim(status)); null status is never closed."""
    terms = _clean_terms(closed_values, "lower")
    s = F.lower(strip(status))
    hit = F.lit(False)
    for t in terms:
        hit = hit | s.contains(t)
    return F.coalesce(hit, F.lit(False))


def closed_exact(status: Column, closed_values: Sequence[object]) -> Column:
    """Set membership on lower(trim(status))."""
    terms = _clean_terms(closed_values, "lower")
    if not terms:
        return F.lit(False)
    return F.coalesce(F.lower(strip(status)).isin(terms), F.lit(False))


def closed_case_sensitive(status: Column, closed_values: Sequence[object]) -> Column:
    """Exact, case-sensitive membership with no trimming."""
    terms = [str(v) for v in closed_values if v is not None]
    if not terms:
        return F.lit(False)
    return F.coalesce(status.isin(terms), F.lit(False))


CLOSED_MATCHERS = {
    "word": closed_word,
    "substring": closed_substring,
    "exact": closed_exact,
    "case_sensitive": closed_case_sensitive,
}


def title_case(c: Column) -> Column:
    """Python ``str.title()``: upper-case a letter that follows a non-letter, lower-case the rest."""
    chars = F.split(F.lower(c), "")
    return F.array_join(
        F.transform(
            chars,
            lambda x, i: F.when(
                (i == 0) | ~F.coalesce(F.get(chars, i - 1).rlike(r"^\p{L}$"), F.lit(False)),
                F.upper(x),
            ).otherwise(x),
        ),
        "",
    )


def category_label(c: Column) -> Column:
    """Display label of a category: underscores to spaces, then title case."""
    return title_case(F.regexp_replace(c, "_", " "))


def pass_rate_text(rate: Column) -> Column:
    """'98.5%' style text of a pass rate, rounded from its exact binary value, ties to even.

    Ten times the rate is the sum of eight times and twice it, both exact; ``low`` is what the sum
    loses, and tells on which side of a tie the exact value lies."""
    eight, two = rate * 8.0, rate * 2.0
    tens = eight + two
    low = two - (tens - eight)
    half = (tens - F.floor(tens)) == 0.5
    rounded = F.when(half & (low > 0), F.ceil(tens).cast("double")).when(half & (low < 0), F.floor(tens).cast("double")) \
        .otherwise(F.rint(tens))
    return F.format_string("%.1f%%", rounded / 10.0)


def points_text(earned: Column, possible: Column) -> Column:
    """'e/p' text of earned over possible points."""
    return F.concat_ws("/", earned.cast("string"), possible.cast("string"))


def quarter_label(ts: Column) -> Column:
    """Calendar quarter label ``YYYY_Qn``."""
    return F.concat(F.year(ts).cast("string"), F.lit("_Q"), F.quarter(ts).cast("string"))


def parse_closed_values(text: str) -> list[str]:
    """Comma-separated closed-status values, trimmed, blanks dropped."""
    return [v.strip() for v in text.split(",") if v.strip()]
