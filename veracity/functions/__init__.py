"""Built-in expression helpers: coercion, text, labels."""

from veracity.functions.coerce import as_double, as_string, as_timestamp, coerce_claims
from veracity.functions.text import (
    CLOSED_MATCHERS,
    category_label,
    pass_rate_text,
    points_text,
    quarter_label,
    title_case,
)

__all__ = [
    "as_double", "as_string", "as_timestamp", "coerce_claims", "CLOSED_MATCHERS",
    "category_label", "pass_rate_text", "points_text", "quarter_label", "title_case",
]
