"""Connected components of a table of links, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """v, c: each linked vertex with the smallest vertex of its component. ``links``: a, b.

    Alternating star steps: every vertex hands its larger neighbours to its smallest one, then
    its smaller neighbours and itself, until every vertex hangs on the smallest of its component.
    Smallest neighbours are partial aggregates, so a vertex with a great many neighbours is no
    single task. Each step is written to the shared folder; the number of steps grows with the
    logarithm of the largest component, and only a count and a checksum reach the driver."""
    e = scratch.stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of u go to its smallest
        large = scratch.stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links_large")
        # small star: the smaller neighbours of u (and u) go to its smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links_small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e, large)
        e = small
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).union(e.select("v", F.col("v").alias("c")).distinct())
