"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is its smallest node.

    Each round joins edges with one row per node, so hub nodes are split like any skewed
    join side; the number of rounds grows with the logarithm of the longest chain. Every
    round is stored. Null ends and loops are ignored. No edges give no rows.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = written(edges.where("a is not null and b is not null and a <> b").select(a, b).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: neighbours above a node hang on its lowest neighbour.
        large = (
            both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = written(large, "large")
        # Small star: a node and its lower neighbours hang on the lowest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(small.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "star")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    rooted = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return rooted.unionAll(roots)
