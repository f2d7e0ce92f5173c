"""Sums of large count vectors that every task has made, in parts: a tree of two levels.

A first level adds up at most TASKS tasks' vectors for each part, the second what the first has left, so that no
task reads more than a bounded share of all, however many tasks there are. Most counts of a task are small or none:
they travel as planes of their bytes (all low bytes first), compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hexloom.llm.arrow import batch, map_arrow

TASKS = 256
SCHEMA = "part int, level long, counts binary"
_TYPES = [pa.int32(), pa.int64(), pa.binary()]


def pack_counts(counts: np.ndarray) -> bytes:
    planes = counts.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def parts_of(total: np.ndarray, parts: int) -> pa.RecordBatch:
    """A task's counts, cut into equal parts."""
    context = TaskContext.get()
    level = context.partitionId() // TASKS if context else 0
    cut = np.split(total.reshape(-1), parts)
    return batch(["part", "level", "counts"], [list(range(parts)), [level] * parts, list(map(pack_counts, cut))], _TYPES)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for part, level, counts in zip(*(b.column(k).to_pylist() for k in range(3))):
            key = (part, level)
            if key in sums:
                sums[key] += unpack_counts(counts)
            else:
                sums[key] = unpack_counts(counts)
    yield batch(["part", "level", "counts"], [[k[0] for k in sums], [k[1] // TASKS for k in sums], list(map(pack_counts, sums.values()))], _TYPES)


def add_up(rows: DataFrame, parts: int) -> np.ndarray:
    """The sums of all parts (rows: SCHEMA), one after the other; their size does not depend on the input's."""
    once = map_arrow(rows.repartition(parts, "part", "level"), _add, SCHEMA)
    found = map_arrow(once.repartition(parts, "part"), _add, SCHEMA).collect()
    out: dict[int, np.ndarray] = {}
    for part, _, counts in found:  # one row for each part, or a few where levels differ
        a = unpack_counts(counts)
        out[part] = out[part] + a if part in out else a
    return np.concatenate([out[k] for k in sorted(out)]) if out else np.zeros(0, np.int64)
