"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges (a, b), for each node of an edge with two ends.

    Every round is two joins on a node; hubs are split as skewed joins. The edge
    table is written each round, so lineage stays short, and the rounds grow with
    the logarithm of a component's diameter, until one changes nothing. Nothing is
    collected but two sums. files: of a round's table at most.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars", files)
    state = None
    for _ in count():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first: a join of two tables is split at a hub, one with an aggregate in its own stage is not
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", files)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node's own link to its least neighbour is a link of the star too
        large = large.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        large = cut(large, "stars", files)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least", files)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        now = cut(small, "stars", files)
        seen = tuple(now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
