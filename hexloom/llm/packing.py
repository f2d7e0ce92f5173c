"""Sum-of-squares packing of tokenised documents into training sequences (operator 9).

Documents become pieces of at most `capacity` tokens. Pieces are dealt into groups of bounded size by a hash of
their identity, and each group is packed by the sum-of-squares rule: of all levels an open sequence may have, and
of a new sequence, the one is chosen after which the sum of the squared counts of open sequences per residual gap
is smallest. Sequences that remain under-filled are dissolved and their pieces packed again, together with those
of the other groups, in rounds over fewer and fewer pieces, so that dealing into groups costs next to nothing.

Defined results: a null text is an empty text and gives one piece that holds only the end token; repeated rows
are packed once each; an empty table gives no pieces; extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, map_arrow, text_bytes
from hexloom.llm.wordbpe import word_bpe
from hexloom.session import shuffle_partitions, stage

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs at once.
GROUP_PIECES = 4096
#: A sequence below this fill is dissolved, in all rounds but the last.
FULL_ENOUGH = 0.995
ROUNDS = 3

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def pieces_of(ids: bytes, capacity: int, end_id: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's pieces, its end token included."""
    ids = memoryview(np.frombuffer(ids + end_id.to_bytes(4, "little"), "<u4").tobytes())
    step = 4 * capacity
    return [(k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step)) for part in (ids[at : at + step],)]


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = word_bpe(path).encode
    for b in batches:
        rows: list[tuple] = []
        for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            rows += [(doc_id, *p, row) for p in pieces_of(encode(text), capacity, end_id)]
        yield batch(_NAMES, list(zip(*rows)) if rows else [[]] * len(_NAMES), _TYPES)


def document_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and row, which tells repeated documents apart."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    return map_arrow(df, partial(_cut, path=tokenizer_path, capacity=capacity, end_id=end_id), PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the order given, and the fill of each bin."""
    counts = np.zeros(capacity + 1, np.int64)  # open bins by level; full ones are closed
    waiting: dict[int, list[int]] = {}
    where, offset, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    levels = np.zeros(0, np.int64)
    stale = False
    for i, s in enumerate(lengths.tolist()):
        if stale:
            levels = np.flatnonzero(counts)
            stale = False
        fit = levels[: np.searchsorted(levels, capacity - s, "right")]
        best = 0
        if s < capacity and len(fit):
            after = counts[fit + s] * (fit + s < capacity)
            cost = np.where(fit + s < capacity, 2 * after + 1, 0) + 1 - 2 * counts[fit]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))  # ties: the fullest
            if cost[k] <= 2 * counts[s] + 1:
                best = int(fit[k])
        if best:
            b = waiting[best].pop()
            counts[best] -= 1
            stale = stale or counts[best] == 0
        else:
            b = len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += s
        if fills[b] < capacity:
            counts[fills[b]] += 1
            stale = stale or counts[fills[b]] == 1
            waiting.setdefault(fills[b], []).append(b)
    return where, offset, np.asarray(fills, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, base: int) -> Iterator[pa.RecordBatch]:
    """Packs this task's groups; rows come sorted by group. A sequence id is made of round, group and number."""
    held: list[pa.RecordBatch] = []
    group = None
    for b in batches:
        ids = b.column("group").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            if group is not None and ids[lo] != group and held:
                yield _packed(held, capacity, base, group)
                held = []
            group = int(ids[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield _packed(held, capacity, base, group)


def _packed(held: list[pa.RecordBatch], capacity: int, base: int, group: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    lengths = t.column("length").to_numpy()
    order = np.lexsort((t.column("piece").to_numpy(), t.column("row").to_numpy(), t.column("doc_id").to_numpy(), -lengths))
    t, lengths = t.take(order), lengths[order]
    where, offset, fills = sum_of_squares(lengths, capacity)
    arrays = [t.column(n).combine_chunks() for n in _NAMES]
    return batch([*_NAMES, "sequence_id", "offset", "fill"], [*arrays, base + group * (1 << 20) + where, offset, fills[where]], [*_TYPES, *[pa.int64()] * 3])


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (of document_pieces, staged)."""
    spark, done, rest = pieces.sparkSession, None, pieces
    for k in range(ROUNDS):
        n = rest.count()
        groups = max(1, -(-n // group_pieces))
        dealt = rest.select(*_NAMES, F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(k)), F.lit(groups)).alias("group"))
        dealt = dealt.repartition(min(groups, 4 * shuffle_partitions(spark)), "group").sortWithinPartitions("group")
        packed = stage(map_arrow(dealt, partial(_pack, capacity=capacity, base=k << 58), PLACE_SCHEMA))
        last = k == ROUNDS - 1 or groups == 1
        full = packed if last else packed.filter(F.col("fill") >= int(capacity * FULL_ENOUGH))
        done = full if done is None else done.unionByName(full)
        if last:
            break
        rest = packed.filter(F.col("fill") < int(capacity * FULL_ENOUGH))
    return done.drop("fill")


def best_fit_packing(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    packed = pack(stage(document_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
