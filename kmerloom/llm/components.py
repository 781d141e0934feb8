"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A node with more neighbours than this, or than a 100,000th of all, is joined by a broadcast.
FEW_NEIGHBOURS = 256


def components(edges: DataFrame, *, write: Callable[[DataFrame, str], DataFrame] = materialize, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges (a long, b long).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each links a node's
    neighbours to the least of them, so a round shuffles the edges once by node and needs no
    node's neighbours in memory; the number of rounds grows with the logarithm of the diameter.
    Every round is written to the shared folder by `write`.

    The neighbours of a large component's centre would all meet in one task. Of E edges fewer than
    2 E / d nodes have more than d neighbours, so with d at least E / 50,000 the centres are at
    most 100,000, whatever the graph: they are broadcast, and their neighbours stay where they are.
    """

    def star(df: DataFrame, large: bool, heavy: int) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("f")).withColumn("m", F.least("m", "u"))
        centres = F.broadcast(least.filter(F.col("f") > heavy).select("u", "m"))
        others = both.join(centres.select("u"), "u", "left_anti").join(least.filter(F.col("f") <= heavy).select("u", "m"), "u")
        out = both.join(centres, "u").unionByName(others)
        if large:
            out = out.filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        else:
            out = out.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
        return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    now = write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    state = None
    for _ in range(max_rounds):
        heavy = max(FEW_NEIGHBOURS, now.count() // 50_000)
        now = write(star(write(star(now, True, heavy), "cc-large"), False, heavy), "cc-round")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(sums):
            break
        state = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
