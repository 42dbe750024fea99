"""Connected components of links that are a table, without bringing any to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.sources.scratch import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (``node``, ``component``) per linked node; the component is its smallest node.

    Alternates large and small stars: every node's neighbours are linked to its
    smallest neighbour, upwards and then downwards, until nothing changes.  Each
    round is written to the shared folder, which cuts the lineage.  A node with
    very many links is summed up before the shuffle.  The join of its links with
    that sum is dealt out by node; adaptive execution splits it where the node's
    partition passes ``spark.sql.adaptive.skewJoin`` thresholds, and below them a
    task has all links of the node.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(links.select(u, v).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
