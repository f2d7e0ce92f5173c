"""Layered configuration: later layers override earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layered(names: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(scope, name, value): for each name the value of the last layer that has it. Layers: scope, name, value."""
    out = names
    for i, x in enumerate(layers):
        out = out.join(x.select("scope", "name", F.col("value").alias(f"_{i}")), ["scope", "name"], "left")
    return out.select("scope", "name", F.coalesce(*(F.col(f"_{i}") for i in reversed(range(len(layers))))).alias("value"))


def merge_chain(entries: DataFrame) -> DataFrame:
    """(scope, path, value): entries of an include chain, merged; the largest level wins, path by path.

    Shallow merges have one path per top-level key; deep ones are flattened to one path per leaf.
    """
    last = entries.groupBy("scope", "path").agg(F.max(F.struct("level", "value")).alias("_last"))
    return last.select("scope", "path", F.col("_last.value").alias("value"))


def inherit(parent: DataFrame, current: DataFrame) -> DataFrame:
    """Provider maps (scope, name, target): what a module is given, overridden by what it declares."""
    c, p = current.withColumnRenamed("target", "_c"), parent.withColumnRenamed("target", "_p")
    return c.join(p, ["scope", "name"], "full_outer").select("scope", "name", F.coalesce("_c", "_p").alias("target"))
