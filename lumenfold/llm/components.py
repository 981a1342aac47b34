"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label): for each node of ``edges(a, b)`` the least node it can reach.

    Each round every node links its greater neighbours to its least one (large star), and then all its lesser
    neighbours and itself to the least of them (small star), until each component is one star. That takes about
    log2(n) rounds, whatever the shape, and never more edges than there were. Edges are written each half round;
    a hub's neighbours are folded by map-side combine, and the lookups are joins that adaptive execution can
    split. Empty edges give no rows.
    """
    links = work.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    was, step = _print(links), 0
    while True:
        step += 1
        both = links.union(links.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("least"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = work.save(large.distinct(), f"{name}-large-{step}")
        near = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(near, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(near)
        links = work.save(small.distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}", f"{name}-large-{step}")
        now = _print(links)
        if now == was:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select("v", "v").distinct())
        was = now
