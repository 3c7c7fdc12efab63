"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, stored


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    onto = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onto.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the least node reachable, for every node with a link.

    Each round is written to the shared folder, so no lineage grows, and hubs are ordinary skewed join
    keys, which adaptive execution splits. Loops and repeated links do no harm.
    """
    edges = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        if not now[0]:
            break
        old, edges = edges, stored(_small_star(_large_star(edges)), "links")
        forget(old)
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
