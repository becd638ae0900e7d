"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v bigint) to staged rows (node, root), root the least node that can be reached; every node of an
    edge but roots has a row. Each round is a few shuffles of the edges that are left and is staged, so an executor's
    loss costs one round; nothing of the graph comes to the driver. Edges with a null or from a node to itself link nothing,
    repeated ones count once, no edges give no rows."""
    x = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = x.union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        x = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        x = stage(x, "edges")
        now = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return x.select(F.col("u").alias("node"), F.col("v").alias("root"))
