"""Column coercions (dates, numbers, strings) as built-in expressions.

Every coercion is null-on-failure (``try_*``), so ANSI mode never raises and
bad values simply become null, which is what the checks then count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted text date layouts, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
)

# Logical columns coerced before the checks run.
DATE_COLUMNS = ("accident_date", "uw_date", "policy_start_date", "policy_end_date", "bdx_month")
NUMERIC_COLUMNS = ("total_incurred", "total_paid", "total_os")
STRING_COLUMNS = ("claim_status", "policy_number", "claim_number")

_TS = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def as_timestamp(c: Column, dtype: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp (NTZ) from any input type; text in none of ``formats`` and numbers become null."""
    if isinstance(dtype, _TS):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        parsed = [F.try_to_timestamp(c, F.lit(fmt)) for fmt in formats]
        return F.coalesce(*parsed).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Double from any input type; unparsable text and NaN become null."""
    if isinstance(dtype, _NUM):
        d = c.cast("double")
    elif isinstance(dtype, (T.StringType, T.BooleanType)):
        d = c.try_cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(d), d)


def double_sql(name: str, dtype: T.DataType) -> str:
    """``as_double`` as SQL text, for predicates given as text."""
    if isinstance(dtype, (*_NUM, T.StringType, T.BooleanType)):
        return f"nullif(try_cast({name} AS DOUBLE), double('NaN'))"
    return "CAST(NULL AS DOUBLE)"


def timestamp_sql(name: str, dtype: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> str:
    """``as_timestamp`` as SQL text."""
    if isinstance(dtype, _TS):
        return f"CAST({name} AS TIMESTAMP_NTZ)"
    if isinstance(dtype, T.StringType):
        quoted = ", ".join("try_to_timestamp({}, '{}')".format(name, f.replace("'", "\\'")) for f in formats)
        return f"CAST(coalesce({quoted}) AS TIMESTAMP_NTZ)"
    return "CAST(NULL AS TIMESTAMP_NTZ)"


def as_string(c: Column) -> Column:
    """String keeping nulls."""
    return c.cast("string")


def coerce_claims(df: DataFrame) -> DataFrame:
    """Coerce the known logical columns of a mapped claims frame in one projection."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in DATE_COLUMNS:
            out.append(as_timestamp(c, types[name]).alias(name))
        elif name in NUMERIC_COLUMNS:
            out.append(as_double(c, types[name]).alias(name))
        elif name in STRING_COLUMNS:
            out.append(as_string(c).alias(name))
        else:
            out.append(c)
    return df.select(*out)
