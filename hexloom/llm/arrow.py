"""Helpers for functions of mapInArrow."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hexloom.session import ship

#: Rows and bytes in an Arrow batch, at most (a single longer row goes alone). Whole texts are carried, so that the
#: engine's defaults (10,000 rows, 2 GiB) could mean gigabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def text_bytes(name: str = "text"):
    """The column's UTF-8 bytes, an empty string for null. Binary columns reach Python without being decoded."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def row_key():
    """64 bits that name a row by its doc_id and its whole text; equal rows have equal keys."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that a column has in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches to ours. They are read when a plan runs, which may be after we
    have returned it, so that they stay; a session that has lower ones keeps them."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def _bytes(x: str) -> int:
    """A setting's number; those with a unit count as unbounded."""
    return int(x) if x.lstrip("-").isdigit() else int(x[:-1]) if x[:-1].isdigit() and x[-1] in "bB" else 0


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow with batches that are bounded in rows and bytes."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(partial(_frugal, fn=fn), schema)


def _frugal(batches: Iterator[pa.RecordBatch], fn: Callable) -> Iterator[pa.RecordBatch]:
    """fn in a worker that gives memory back: workers live on after a task, and their pools would keep its peak."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield from fn(batches)
    finally:
        if _libc is not None:
            _libc.malloc_trim(0)


def _c_library():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:  # not a GNU system: memory is given back when the worker ends
        return None


_libc = _c_library()


def batch(names: list[str], arrays: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(arrays, types)], names=names)
