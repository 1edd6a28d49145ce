"""Connected components of a link table, by alternating star contractions.

Every round is joins and grouped minima over the remaining links, written as
a table in the shared checkpoint folder, so the lineage stays short and a
lost executor costs one round at most.  Nothing is collected but a count, and
no join is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import join_totals


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return join_totals(both.where("b > a"), low, "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    joined = join_totals(e, low, "b")
    return (joined.select(F.col("m").alias("x"), F.col("a").alias("y"))
            .unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that has a link; root is the smallest
    node reachable.  ``links`` may repeat and may hold either direction."""
    e = cut_lineage(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")

    def state(t):
        return t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    before = state(e)
    while before[0]:
        e = cut_lineage(_small_star(_large_star(e)), "stars")
        now = state(e)
        if now == before:
            break
        before = now
    return (e.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))
