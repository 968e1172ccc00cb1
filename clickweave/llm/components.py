"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickweave.llm.common import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (a, b) of long ids, either way round, repeats allowed. Returns (id, component), the
    smallest id reachable, for every id that has an edge.

    Large-star and small-star steps in turn until no edge changes: every step groups the edges by a
    vertex, takes the minimum with a partial aggregate before the shuffle, and writes its edges, so
    a vertex with a third of all edges is one row per task in the aggregate and a skewed join that
    Spark splits. Edges stay at most as many as they were; the driver reads one row per round (count and fingerprint)."""
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        # large-star: neighbours above a vertex go to the least of its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = written(large, name)
        # small-star: a vertex and its neighbours below it go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = (moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        small = written(small, name)
        now = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        pairs = small
        if now == before or now[0] == 0:
            break
        before = now
    roots = pairs.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
