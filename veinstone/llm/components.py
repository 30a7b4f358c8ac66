"""Connected components of a graph in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges up to which the least neighbours (two rows of about 150 bytes for an edge at most) are broadcast, so that a node with many edges makes no large task.
BROADCAST_EDGES = 100_000


def _near(least: DataFrame, n: int) -> DataFrame:
    return F.broadcast(least) if n <= BROADCAST_EDGES else least


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(_near(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    made = down.join(_near(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``u, v``; values of one comparable kind): the least node that is linked to it.

    Neighbours are never gathered: each step aggregates least values and joins them back, which adaptive execution
    splits at nodes with many edges. Edges of a node to itself and null ends are ignored. The number of steps grows
    with the logarithm of the longest path.
    """
    edges = materialize(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct())
    state = _state(edges)
    while state[0]:
        edges = materialize(_small(_large(edges, state[0]), state[0]))
        last, state = state, _state(edges)
        if last == state:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
