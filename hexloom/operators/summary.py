"""Summaries: components, modules, table sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("resource", "data", "module", "output", "variable", "local", "provider")


def component_summary(components: DataFrame, rows: DataFrame, environments: DataFrame) -> DataFrame:
    """components (component_path) with counts of their rows (component_path, kind) and their sorted environments."""
    counts = rows.groupBy("component_path").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in KINDS))
    seen = environments.groupBy("component_path").agg(F.sort_array(F.collect_set("environment")).alias("environments_seen"))
    out = components.join(counts, "component_path", "left").join(seen, "component_path", "left")
    return out.select("component_path", *(F.coalesce(f"{k}_count", F.lit(0)).cast("bigint").alias(f"{k}_count") for k in KINDS), F.coalesce("environments_seen", F.array().cast("array<string>")).alias("environments_seen"))


def modules_table(calls: DataFrame, walked: DataFrame) -> DataFrame:
    """(source_kind, source_raw, call_count, resolved): called sources, and walked modules that no call names."""
    called = calls.groupBy("source_kind", "source_raw").agg(F.count(F.lit(1)).alias("call_count"))
    rest = walked.select("source_kind", "source_raw").distinct().join(called, ["source_kind", "source_raw"], "left_anti")
    both = called.unionByName(rest.withColumn("call_count", F.lit(0).cast("bigint")))
    return both.join(walked.select("source_kind", "source_raw").distinct().withColumn("_w", F.lit(True)), ["source_kind", "source_raw"], "left").select("source_kind", "source_raw", "call_count", F.coalesce("_w", F.lit(False)).alias("resolved"))


def external_modules(calls: DataFrame) -> DataFrame:
    """(source_raw, source_kind, file, line, column) of sources that are not local, each where it is first called."""
    place = F.min(F.struct("file", "line", "column")).alias("first")
    first = calls.filter("source_kind <> 'local'").groupBy("source_raw", "source_kind").agg(place)
    return first.select("source_raw", "source_kind", "first.*")


def unresolved_count(rows: DataFrame, key: str, json: str) -> DataFrame:
    """How many symbolic leaves the JSON of each key's rows has."""
    return rows.groupBy(key).agg(F.sum(F.regexp_count(F.col(json), F.lit('"__unresolved__":'))).cast("bigint").alias("unresolved_count"))
