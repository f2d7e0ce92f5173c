"""Instances of `count` and `for_each`, and modules inlined into their callers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_INSTANCES = 1024
MAX_DEPTH = 8


def expand_count(df: DataFrame, count: str, address: str, cap: int = MAX_INSTANCES) -> DataFrame:
    """A row for each instance, its address indexed. An unknown count, or one over the cap, keeps one template row."""
    n = F.col(count)
    template = n.isNull() | (n > cap)
    index = F.explode(F.when(template, F.array(F.lit(-1))).when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1)))
    out = df.withColumn("_index", index)
    return out.withColumn(address, F.when(F.col("_index") < 0, F.col(address)).otherwise(F.concat(address, F.lit("["), F.col("_index"), F.lit("]")))).withColumn("is_template", F.col("_index") < 0).drop("_index")


def expand_keys(df: DataFrame, keys: str, address: str) -> DataFrame:
    """A row for each distinct key of `for_each`, quotes and backslashes dropped from the address."""
    out = df.withColumn("_key", F.explode(F.array_sort(F.array_distinct(F.col(keys)))))
    return out.withColumn(address, F.concat(address, F.lit('["'), F.translate("_key", '"\\', ""), F.lit('"]'))).withColumnRenamed("_key", "each_key")


def flatten_modules(calls: DataFrame, bodies: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Resources of called modules, with addresses prefixed by their chain of calls.

    calls: owner (a component, or a module that calls), name, target (a module). bodies: module, address. A chain
    never enters a module twice, and goes `depth` calls deep at most. Returns component, address, depth.
    """
    level = calls.select(F.col("owner").alias("component"), F.concat(F.lit("module."), "name", F.lit(".")).alias("prefix"), "target", F.array("target").alias("chain"), F.lit(1).alias("depth"))
    out = None
    for k in range(depth):
        part = level.join(bodies, level["target"] == bodies["module"]).select("component", F.concat("prefix", "address").alias("address"), "depth")
        out = part if out is None else out.unionByName(part)
        if k + 1 < depth:
            inner = calls.select(F.col("owner").alias("_owner"), F.col("name").alias("_name"), F.col("target").alias("_target"))
            level = level.join(inner, (level["target"] == inner["_owner"]) & ~F.array_contains("chain", F.col("_target"))).select(
                "component", F.concat("prefix", F.lit("module."), "_name", F.lit(".")).alias("prefix"), F.col("_target").alias("target"), F.array_append("chain", F.col("_target")).alias("chain"), (F.col("depth") + 1).alias("depth")
            )
    return out
