"""Connected components by alternating large-star and small-star steps, in DataFrames only.

Both steps replace the links of a node by links to the smallest node around it, so the number of links never grows
and the rounds grow with the logarithm of the longest path. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize


def connected_components(links: DataFrame, src: str, dst: str, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of a link. Links are undirected."""
    a, b = F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")
    edges = materialize(links.select(a, b).filter("lo < hi").distinct(), "links")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
    for _ in range(max_rounds):
        # large star: from every node, its larger neighbours point to the smallest of its neighbours and itself
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("low").alias("lo"), F.col("m").alias("hi")).distinct()
        # small star: every node and its smaller neighbours point to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low, "hi").select("low", F.explode(F.array("lo", "hi")).alias("hi")).filter("low < hi")
        edges = materialize(small.select(F.col("low").alias("lo"), "hi").distinct(), "links")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
