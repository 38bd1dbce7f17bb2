"""Connected components by alternating large-star and small-star, as joins and pre-aggregated minima.

No node's neighbour list is ever gathered: a node only needs the minimum over its neighbours, which
aggregates before the shuffle, and the edges are joined back to it (a hub is a skewed equi-join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` may repeat pairs, hold them in either direction, and hold self-links or nulls, which are ignored.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = (
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    edges = staged(edges, "edges")
    mark = _fingerprint(edges)
    while mark[0]:
        edges = staged(_small_star(_large_star(edges)), "edges")
        before, mark = mark, _fingerprint(edges)
        if mark == before:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
