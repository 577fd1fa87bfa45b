"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Links every kept neighbour of a node to the smallest of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where(keep)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (bigint columns ``u``, ``v``): the smallest node it reaches.

    Large and small stars in turn, each a grouped minimum and a join, until nothing changes; the number of
    rounds grows with the logarithm of the longest path. Every round is a table in the
    shared folder. Loops and repeated edges do no harm; null ends are left out.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = materialise(now, "components")
    mark = None
    while True:
        large = _star(_both(now), "v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: edges point from the larger node to the smaller, so its neighbours are all smaller
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        linked = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialise(linked.where("u <> v").distinct(), "components")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    # at the end every node points straight at the smallest one
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
