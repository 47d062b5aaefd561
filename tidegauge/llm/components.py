"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise


def _stars(pairs: DataFrame) -> DataFrame:
    """Per node the smallest neighbour or itself, next to each neighbour.

    The minimum is combined on the map side and joined back, so a centre with
    most of the nodes is an ordinary skewed join key, not one group.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node.

    Each round links larger neighbours to the local minimum (large star), then
    smaller ones (small star); the number of rounds is logarithmic in practice.
    Every round is written to the shared folder, which cuts the lineage. An
    empty edge table gives an empty result; loops and repeated edges are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).toDF("u", "v")
        now = materialise(linked.where("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).head()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    settled = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return settled.union(now.select("v", "v").distinct().toDF("node", "root"))
