"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` but the roots; ``root`` is the least node reachable.

    A node with very many neighbours is never gathered: minima are combined before the shuffle, and the join back has a
    hot side that Spark splits at run time.  Each round is written, so that a lost executor costs one round at most.
    The rounds needed grow with the logarithm of the longest chain.
    """
    tie = edges.filter("a <> b").select("a", "b")
    state, before = written(tie.distinct()), None
    while True:
        # equal states have equal digests; for different ones two 64-bit digests would have to agree
        one, two = F.xxhash64("a", "b"), F.xxhash64(F.lit(1), "b", "a")
        now = state.agg(F.count("*"), F.bit_xor(one), F.bit_xor(two), F.sum(one.cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        after = written(_small_star(_large_star(state)))
        drop_written(state)
        state, before = after, now
