"""Connected components by alternating large-star and small-star.

Every half-step is one grouped minimum and one join, so a node's neighbours
never meet in one place: the join's sides are dealt anew for it, so that the
links of a star's centre can be split over tasks where they are many. Each
round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import Store


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each node, as if no one knew that it's dealt by node."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.coalesce("u", "m").alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = _least(down)
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, store: Store, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another: the least node that it reaches.

    Links of a node to itself, repeated links and nulls add nothing; without
    links the result is empty. Stops at the first round that changes no link.
    """
    now = store.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
        after = store.cut(_small_star(_large_star(now)).distinct(), "edges")
        store.drop(now)
        now = after
    return members(now)


def members(stars: DataFrame) -> DataFrame:
    """The nodes of a forest of stars: every node but the centres occurs once on the left."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
