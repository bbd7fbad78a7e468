"""Connected components of links held in tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import releasing, stored


@functools.partial(releasing, few=True)
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the smallest node it is linked with) of every node in a link.

    Turns of two steps: a node's larger neighbours move to its smallest one, then its
    smaller neighbours do; what remains are stars.  Smallest neighbours are grouped in
    each task first and joined back from a stored table, so a node with a third of all
    links is a row a task and its join can be split.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges", few=True
    )
    unfinished = True
    while unfinished:
        both = edges.union(edges.select("v", "u"))
        lowest = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "lowest", few=True)
        moved = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(moved.where("u != v").distinct(), "edges", few=True)
        lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
        down = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        edges = stored(down.union(lowest.select("u", F.col("low").alias("v"))).distinct(), "edges", few=True)
        # Stars: every node has one smaller neighbour or only larger ones.
        sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        seen = sides.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        unfinished = not seen.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
