"""Connected components of a table of links, by alternating large stars and small stars (Kiveris et al. 2014).

Nothing is collected: each step is a minimum for each node, partially aggregated, and a join with that minimum from a
written table, so that a node with many links can be split. Ends when a round changes no link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v; each node's smaller (small star) or all (large star) neighbours point to the least."""
    both = links.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if large:
        both = both.union(links.select("v", "u"))
    least = cut(both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m")))
    joined = both.join(least, "n")
    if large:
        out = joined.where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link to another; component is the least node."""
    now = cut(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct())
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).alias("s")
    before = now.select(sign).first()[0]
    while before["n"]:
        now = cut(_star(cut(_star(now, True)), False))
        after = now.select(sign).first()[0]
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut(nodes.union(nodes.select("component", "component")).distinct())
