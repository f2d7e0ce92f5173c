"""First-wins semantics, by an order that the data carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of each key's rows the first, whole.

    A map-side minimum over (order, row) instead of a window: a hot key is reduced before it is shuffled.
    """
    cols = df.columns
    picked = df.groupBy(*keys).agg(F.min(F.struct(*(F.col(o).alias(f"_{i}") if isinstance(o, str) else o.alias(f"_{i}") for i, o in enumerate(order)), F.struct(*cols).alias("_row"))).alias("_first"))
    return picked.select("_first._row.*")


def later_ones(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows that first_by() leaves out: what is reported as a collision.

    Equal rows are counted, and one of each key's least is left out: no window, so that a hot key needs no task of its
    own.
    """
    places = [F.col(o).alias(f"_{i}") if isinstance(o, str) else o.alias(f"_{i}") for i, o in enumerate(order)]
    rows = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*places, F.struct(*df.columns).alias("_row")).alias("_at"))
    names = [f"_k{i}" for i in range(len(keys))]
    counted = rows.groupBy(*names, "_at").agg(F.count(F.lit(1)).alias("_n"))
    least = rows.groupBy(*names).agg(F.min("_at").alias("_first")).select(*(F.col(k).alias(f"{k}_") for k in names), "_first")
    both = counted.join(least, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names])
    left = both.withColumn("_n", F.col("_n") - F.when(F.col("_at") == F.col("_first"), 1).otherwise(0)).filter("_n > 0")
    return left.select("_at._row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
