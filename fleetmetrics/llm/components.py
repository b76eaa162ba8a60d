"""Connected components by alternating stars.

Large-star links every larger neighbour of a node to the smallest of its neighbourhood, small-star
every smaller one; both keep connectivity, and the links become stars whose centre is the smallest
node in a logarithmic number of rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). A node's neighbours are never gathered: the smallest comes from an aggregation and
is joined back. Both sides of that join are plain tables, so the centre of a large star, whose links
may be a third of all, can be split over tasks. Every round is written to the shared folder, which
cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "centres")
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = stored(links.groupBy("b").agg(F.min("a").alias("m")), "centres")
    near = links.join(least, "b")
    up = near.select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return up.where("a < b").union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the smallest node reachable."""
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    seen = None
    while True:
        now = stored(_small_star(stored(_large_star(now), "large-stars")), "links")
        # stars: no node is both a centre and a leaf, and a leaf has one centre
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
