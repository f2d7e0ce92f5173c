"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour. Minima are taken by map-side aggregation and joined
back from a written table, so that a hub's edges are spread by the engine's skew-join handling. No edge, label or
component is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.session import stage


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), rows=2 * rows)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), rows=rows)
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its smallest node. Edges: u, v longs.

    rows: how many edges there are at most, if that is known.
    """
    edges = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows=rows)
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        if now[0] == 0:
            break
        n = now[0]  # a large star has an edge for each end of an edge at most; distinct small stars have fewer
        edges = stage(_small_star(stage(_large_star(edges, n), rows=n), n), rows=2 * n)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
