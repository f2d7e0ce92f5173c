"""Dependency edges and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.operators.dedup import first_by


def references(df: DataFrame, source: str, text: str, pattern: str) -> DataFrame:
    """(source, ord, target): each match of the pattern's first group in the text, in order."""
    return df.select(source, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("ord", "target"))


def distinct_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges once each by (from_address, to_address, edge_kind); the first decides the other columns."""
    return first_by(edges, ["from_address", "to_address", "edge_kind"], order)


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): the nodes reachable by at most `depth` edges, each at its least depth.

    edges: u, v. Each round walks on from new nodes only, so that a node is expanded once for each start.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(depth):
        step = front.join(edges, front["node"] == edges["u"]).select("start", F.col("v").alias("node")).distinct()
        front = step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(k + 1))
        seen = seen.unionByName(front)
    return seen
