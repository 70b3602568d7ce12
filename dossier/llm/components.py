"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    each = F.explode(F.array("a", "b")).alias("x")
    return moved.select(each, "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with a link to a smaller one.

    ``links`` holds pairs ``a, b`` in any direction. Large and small stars alternate until the
    links stop changing, which takes a few rounds: each round at least halves long chains. A
    round is written to the shared folder; the driver sees a count and a checksum. Nodes that
    are the smallest of their component, and nodes without links, are not listed.
    """
    spark = links.sparkSession
    store = Stored(spark, "components")
    now = store.write(links.filter("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        after = store.write(_small_star(_large_star(now).distinct()).distinct())
        seen = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        store.drop(now)
        now = after
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
