"""Python islands over rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from hexloom.session import ship


def _run(batches: Iterator[pa.RecordBatch], fn, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([out for row in b.to_pylist() for out in fn(row)], schema=schema)


def _group(t: pa.Table, fn, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(fn(t.to_pylist())), schema=schema)


def _schema(s: str) -> StructType:
    return _parse_datatype_string(s)


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Each row to any number of rows."""
    ship(df.sparkSession)
    s = _schema(schema)
    return df.mapInArrow(partial(_run, fn=fn, schema=to_arrow_schema(s)), s)


def map_groups(df: DataFrame, key: str, fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Each key's rows, which have to be few, to any number of rows."""
    ship(df.sparkSession)
    s, arrow = _schema(schema), to_arrow_schema(_schema(schema))

    def run(t):
        return _group(t, fn, arrow)

    return df.groupBy(key).applyInArrow(run, s)
