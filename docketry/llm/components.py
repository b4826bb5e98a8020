"""Connected components of links by alternating large and small stars.

Every round hooks each node's neighbours onto the least node around it; no node's neighbours are ever gathered, so a
hot node is a minimum by key, summed before it is shuffled. Rounds go on until nothing changes. Each round is
written to the shared folder, and the one before is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import drop_path, written_path


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the least node that links reach. links: a, b (long); repeats are allowed."""
    spark = links.sparkSession
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path = written_path(pairs.distinct(), "links")
    last = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: a node's smaller neighbours, and the node, hook onto the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        new, new_path = written_path(small.distinct(), "links")
        drop_path(spark, path)
        edges, path = new, new_path
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last = state
