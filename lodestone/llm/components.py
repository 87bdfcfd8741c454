"""Connected components of a link table by alternating large and small stars.

Every round is a few joins and aggregations on the links left; lineage is cut by a stored table, no link
reaches the driver, and the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import dropped, stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; component is its smallest node.

    ``links`` has two columns of one orderable type. Links with a null end are left out; repeated links
    and links of a node with itself change nothing; without links the result is empty.
    """
    x, y = (F.col(c) for c in links.columns)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges, before = stored(edges, "links"), None
    while True:
        stamp = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == before or not stamp[0]:
            break
        before, old = stamp, edges
        edges = stored(_small(_large(edges)).where("a > b").distinct(), "links")
        dropped(old)
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
