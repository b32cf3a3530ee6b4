"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: a > b. Large: each node links its greater neighbours to its least; small: its lesser neighbours and itself."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = scratch.keep(near, "near")
    least = scratch.keep(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    met = near.join(least, "u")
    if large:
        out = met.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("u <> m").select("u", "m"))
    out = scratch.keep(out.distinct(), "star")
    scratch.drop(near, least)
    return out


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links: the least node it reaches. No node's links are gathered: steps are
    group minima and joins, and the edges shrink to stars."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(edges)
    while before[0]:
        step = _star(_star(edges, True), False)
        after = mark(step)
        scratch.drop(edges)
        edges = step
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
