"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialize, scratch


def _stars(edges: DataFrame) -> bool:
    """Edges (a, b) are a forest of stars: each node a has one edge, and no centre b has one."""
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast(edges.schema["b"].dataType).alias("b")))
    return ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n"), F.count("b").alias("out")).where("low <> high or out > 0 and n > out").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable. edges: columns a, b of any orderable type; loops and repeats do no harm.

    Each round re-links neighbours to the least neighbour, so stars and chains close in a number of rounds that grows
    with the logarithm of their length. Every round is a written table. Edges of a hot node don't gather in one task. No
    edges give no rows.
    """
    with scratch(edges.sparkSession) as own:
        now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        while not _stars(now):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            # larger neighbours go to the least of the neighbourhood
            large = join_by_key(now.select(F.col("a").alias("v"), F.col("b").alias("a")), least, ["a"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
            large = materialize(large, "large")
            small_least = large.groupBy("a").agg(F.min("b").alias("m"))
            # smaller neighbours, and the node itself, go to the least of the smaller
            small = join_by_key(large, small_least, ["a"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
            now = materialize(small, "edges")
            own.only(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
