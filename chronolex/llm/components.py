"""Connected components of an edge table by alternating large-star and small-star rounds, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.storage import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) as a table: the smallest node reachable, for every node of the edges (a, b). Runs until nothing changes.

    Each half round replaces every edge by one to a node's smallest neighbour. Minima are aggregated before the
    shuffle and joined back, so a node with very many edges is split like any skewed join key. A round's tables are
    removed once the next one's are written.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(current)
    while before[0]:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = materialise(small.where("u <> v").distinct(), "edges")
        after = _digest(small)
        discard(large, current)
        current = small
        if after == before:
            break
        before = after
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = materialise(stars.union(stars.select(F.col("component").alias("node"), "component").distinct()), "labels")
    discard(current)
    return found


def _digest(edges: DataFrame) -> tuple:
    """Number and hash sums of the (distinct) edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
