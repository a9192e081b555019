"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, heavy_above, join_to_one


def _ends(edges: DataFrame) -> DataFrame:
    """(u, v): each edge (hi, lo) from either end."""
    return edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step: a shuffle each, and one for the distinct edges.  edges: (hi, lo) with hi > lo."""
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    large = _ends(edges).withColumn("m", least).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
    small = large.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
    both = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return small.select(F.inline(both)).where("hi > lo").distinct()


def _stars_with_hubs(edges: DataFrame, heavy: int) -> DataFrame:
    """The same steps where nodes have over `heavy` edges: these meet their least neighbour by a broadcast."""
    both = _ends(edges)
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    large = join_to_one(both.where("v > u"), least, ["u"], "n", heavy).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    small = join_to_one(large, least, ["hi"], "n", heavy).where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple[int, object]:
    """The number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _most_edges(edges: DataFrame) -> int:
    return _ends(edges).groupBy("u").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def connected_components(edges: DataFrame, scratch: Scratch, name: str, most: int = 200) -> DataFrame:
    """(node, label) for every node with a link; label is the smallest node of its component.

    edges: (u, v), in any direction, loops and repeats allowed; rows with nulls are dropped.
    Each round is written to the shared folder, which cuts the lineage.  Rounds grow with the
    logarithm of the nodes; more than `most` of them are an error.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")
    )
    at = scratch.save(edges.distinct(), f"{name}-0")
    state = _state(at)
    for k in range(1, most):
        before = state
        heavy = heavy_above(2 * before[0])
        # no node has more edges than there are
        hubs = before[0] > heavy and _most_edges(at) > heavy
        at = scratch.save(_stars_with_hubs(at, heavy) if hubs else _stars(at), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = _state(at)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not whole after {most} rounds")
    stars = at.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
