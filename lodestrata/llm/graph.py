"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """From links (a, b) to (id, component): the smallest id that can be reached, for every id in a link.

    Each round hangs every node's larger neighbours under its smallest one, then likewise the smaller ones; after O(log n) rounds (log squared at worst) every
    node hangs under its component's smallest.  Minima are combined before the shuffle, and joins may split a hot
    node.  Links from an id to itself and repeated links do no harm; no links give an empty result."""
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), "links")
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias(
            "u"), F.col("m").alias("v")).distinct()
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
