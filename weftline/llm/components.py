"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import stage


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a link table."""
    part = F.xxhash64("x", "y").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(part)).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of `edges` (a, b), both long or both strings: label is the smallest node reachable.

    Each round is two aggregations and two joins against one row per node, so no hub meets its neighbours pairwise,
    and is written to the shared folder. The number of rounds grows with the logarithm of the longest chain.
    Loops, repeated links and an empty table are allowed; a node with a null end is left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    now = stage(edges, "links")
    seen = _print(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = stage(small.unionAll(low.select("x", F.col("m").alias("y"))).distinct(), "links")
        before, seen = seen, _print(now)
        if seen == before:
            break
    roots = now.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct()
    return now.select(F.col("x").alias("node"), F.col("y").alias("label")).unionAll(roots)
