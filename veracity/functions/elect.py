"""Date layouts elected by their column (P5): each text value votes for the layouts that it can be read in, the
layout with most votes is applied to the whole column, and columns that two layouts read equally well are reported.

So one column is read in one layout, whatever the order of its rows, and day-first files need no setting. Votes of all columns
are counted in one aggregate over those columns. The winner stays a subquery of the plan: nothing is collected, and
a value is parsed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.functions.coerce import DATE_FORMATS, as_timestamp

# The layouts that stand for election. Of equally many votes, the first wins.
LAYOUTS = (*DATE_FORMATS, "dd/MM/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyy/MM/dd",
           "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss")


def _read(c: Column, layout: str) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(layout)).cast("timestamp_ntz")


def _text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]


def _tally(df: DataFrame, columns: Sequence[str], layouts: Sequence[str]) -> DataFrame:
    """One row: by column the number of its values and of its votes by layout."""
    aggs = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        aggs.append(F.count_if(F.trim(c) != "").alias(f"n{i}"))
        aggs.append(F.array(*(F.count_if(_read(c, f).isNotNull()) for f in layouts)).alias(f"v{i}"))
    return df.agg(*aggs)


def elect_dates(df: DataFrame, columns: Sequence[str], layouts: Sequence[str] = LAYOUTS) -> DataFrame:
    """``df`` with ``columns`` as timestamps: text in its column's elected layout, null where it can't be read so; other types
    as ``as_timestamp`` gives them."""
    texts = _text_columns(df, columns)
    if not texts:
        winners = None
    else:
        best = [F.when(F.array_max(f"v{i}") > 0, F.array_position(f"v{i}", F.array_max(f"v{i}")) - 1).otherwise(-1).cast("int")
                for i in range(len(texts))]
        winners = _tally(df, texts, layouts).select(F.array(*best).alias("w")).scalar()
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in texts:
            at = F.get(winners, texts.index(name))
            parsed = F.when(at == 0, _read(c, layouts[0]))
            for k, layout in enumerate(layouts[1:], 1):
                parsed = parsed.when(at == k, _read(c, layout))
            c = parsed
        elif name in columns:
            c = as_timestamp(c, df.schema[name].dataType)
        out.append(c.alias(name))
    return df.select(*out)


def elected_layouts(df: DataFrame, columns: Sequence[str], layouts: Sequence[str] = LAYOUTS) -> DataFrame:
    """One row a text column: the number of its values that aren't blank, the elected layout (null: no value can be read) and its
    votes, the next layout with votes, and whether the two have equally many (``ambiguous``)."""
    texts = _text_columns(df, columns)
    spark = df.sparkSession
    if not texts:
        return spark.createDataFrame([], "column string, n_values long, layout string, votes long, runner_up string, runner_up_votes long, ambiguous boolean")
    names = F.array(*(F.lit(f) for f in layouts))
    rows = F.array(*(F.struct(F.lit(t).alias("column"), F.col(f"n{i}").alias("n_values"), F.col(f"v{i}").alias("v")) for i, t in enumerate(texts)))
    ranked = F.array_sort(F.transform("v", lambda x, k: F.struct((-x).alias("less"), k.alias("k"))))
    r = _tally(df, texts, layouts).select(F.inline(rows)).withColumn("r", ranked)
    first, second = -F.col("r")[0]["less"], -F.col("r")[1]["less"]
    return r.select("column", "n_values", F.when(first > 0, F.get(names, F.col("r")[0]["k"])).alias("layout"), first.alias("votes"),
                    F.when(second > 0, F.get(names, F.col("r")[1]["k"])).alias("runner_up"), second.alias("runner_up_votes"),
                    ((first > 0) & (first == second)).alias("ambiguous"))
