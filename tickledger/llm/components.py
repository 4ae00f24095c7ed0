"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm import texts as X
from tickledger.operators.skew import split_join


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component``: of every linked node, the smallest node it can reach.

    ``links`` has two long columns ``a`` and ``b``; loops and repeated links are harmless, null ends
    are left out. Each round keeps no more links than there were; the links of a node with very many
    are split in its joins. No links give no rows.
    """
    ends = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ends).distinct()
    links, before = X.stored(links, "links"), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # every larger neighbour to the smallest of the neighbourhood
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(both.where("v > u"), least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # every smaller neighbour and the node itself to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        links = X.stored(small.distinct(), "small-star")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
