"""Connected components over a table of links, by alternating large-star and small-star steps.

Each step is one aggregation and one join on the links; hubs are summed on the map side, and in the join the
links of a node are dealt to SALTS tasks, which adaptive execution splits further. Every round is written to the shared folder, so that the lineage stays
short, and nothing but two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links with the row of least for their u; the links of a hub are spread over SALTS keys."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    each = least.withColumn("salt", F.explode(F.lit(list(range(SALTS))))).hint("merge")  # its size is underestimated: not to be broadcast
    return dealt.join(each, ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of links (u, v: long, u != v)."""
    now = C.materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    state = None
    while True:  # the steps are known to end; long chains take a number of rounds near the logarithm of their length
        after = C.materialise(_small_star(_large_star(now).where("u > v")).distinct(), "links")
        # a sum of hashes tells whether the links are the same; every node has one link when they are stars
        got = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        C.release(now)
        now = after
        if tuple(got) == state:
            break
        state = tuple(got)
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
