"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.scratch import Staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Small star: each node links itself and its smaller neighbours to the smallest of them.
    Large star: each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges if small else edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: each u has one v, and no v is a u."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return not several.union(chained).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long): the component is its
    smallest node. Each round is written and read again; nothing but one row count reaches the driver."""
    stage = Staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(stage.df):
        large = _star(stage.df, small=False)
        after = Staged(_star(large, small=True), "edges")
        stage.drop()
        stage = after
    return stage.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stage.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
