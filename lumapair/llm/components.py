"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on written tables, so adaptive
execution can split a node with very many neighbours. Nothing is collected but
two sums per round, which tell whether the links still change; rounds end by
themselves, after about the logarithm of the longest chain. A round's tables are
removed when the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.session import discard, materialize


def _stars(links: DataFrame, least: DataFrame) -> DataFrame:
    """(v, smallest of u's neighbourhood) for each link (u, v)."""
    return links.join(least, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable, for every node that a link names."""
    ordered = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    ordered = materialize(ordered, "links")
    before = None
    while True:
        both = materialize(ordered.union(ordered.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = materialize(_stars(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        smallest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = _stars(large, smallest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, ordered = ordered, materialize(small.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = ordered.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(old, both, least, large, smallest)
        if now == before:
            break
        before = now
    roots = ordered.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
