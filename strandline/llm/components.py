"""Connected components of a link table, by star contraction in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, root) for each linked node: root is the smallest node it reaches.

    Each round first hangs a node's larger neighbours, then its smaller ones, on the smallest of all (the large-star
    and small-star steps of Kiveris and others, 2014); the rounds needed grow with the logarithm of the longest chain.
    A node's neighbours are never gathered in one row. Links with null ends and from a node to itself are left out.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the smallest neighbours are tables, so that Spark can split the join's part of a node with very many links
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        dropped(least)
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _state(after)
        for old in (links, down, least):
            dropped(old)
        links = after
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
