"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.where("b > a").join(low, "a").where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    linked = edges.join(low, "a")
    return (linked.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b"))).distinct())


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``id``, ``component`` (smallest id of the component) for every id of
    ``links`` (``a``, ``b``: long) but the smallest of each component.  The
    components of earlier links, ``known``, are joined by the new ones: those
    links need not come again, and no new ones cost no pass.

    Each pass writes its links to the shared folder; a few passes bring any
    graph to stars.  Counts decide when to stop; no link comes to the driver.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    if known is not None:
        if links.isEmpty():
            return known
        links = links.select("a", "b").union(known.select("id", "component"))
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct(), "links")
    now = state(edges)
    while now[0]:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
