"""Connected components of a graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Links that one task handles; a graph with few is not dealt to all partitions of a shuffle, whose files would be empty.
TASK_LINKS = 50_000


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b) with a link to another node.

    Each round points the larger neighbours of every node, then the smaller ones, at the smallest (Kiveris et al.
    2014), until nothing changes. A node with very many neighbours is one row beside many in a join, never a list.
    """
    shared_dir(links.sparkSession)  # checkpoints need it
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        tasks = max(1, -(-state[0] // TASK_LINKS))
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(2 * tasks).distinct().coalesce(2 * tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(2 * tasks).distinct()
        edges = small.coalesce(tasks).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = now
