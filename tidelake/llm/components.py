"""Connected components of a link table, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.session import materialize


def components(links):
    """(node, component): the smallest node reachable from every node of ``links`` (a, b longs).

    Large and small stars in turn: neighbours are linked to the smallest node around, which
    roughly halves the distance to it each round, until nothing changes. Every round is
    written to the shared folder, so no lineage grows.
    """
    def both(pairs):
        return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(pairs):
        return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))

    def ordered(pairs):
        out = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        return materialize(out.distinct(), "stars")

    def state(pairs):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = ordered(links.select("a", "b"))
    seen = state(pairs)
    while True:
        around = both(pairs)
        # every larger neighbour of a node goes to the smallest node around it
        pairs = ordered(around.where("b > a").join(least(around), "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        # every node and its smaller neighbours go to the smallest of them
        low = pairs.groupBy("a").agg(F.min("b").alias("low"))
        own = pairs.join(low, "a")
        pairs = ordered(own.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))))
        now = state(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select("b", "b").distinct())
