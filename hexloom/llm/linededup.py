"""Cross-site line deduplication by distinct-site spread (operator 6).

Each line of each document is hashed. A HyperLogLog sketch of the sites per line hash is built by map-side
aggregation and merged; sketches far over the spread threshold settle a line, and lines near it get exact distinct
counts, in a second pass that carries those lines only. Lines spread over `min_sites` sites or more are boilerplate
and leave every document.

Which lines leave is applied inside the documents' own partitions, from a broadcast list of hashes while its
counted size is within BROADCAST_LINES; beyond that, by a join of line hashes that carries no text.

A line is known by the 64-bit hash of its bytes: at 1e10 distinct lines some three pairs are expected to collide,
and a line that collides with a boilerplate line would leave with it.

Defined results: null texts have no lines and stay null; a null site is no site; blank lines (fewer than `min_chars`
code points besides white space) are never boilerplate, all other lines may be, however short or long; repeated rows
count their site once and get a row each; an empty table gives no rows; extra columns come through unchanged, and the
two counts take other names (with underscores before them) where a column has theirs in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, free_names, map_arrow
from hexloom.session import stage

MIN_SITES = 5
MIN_CHARS = 1
SKETCH_LOG2 = 10
#: Sketch estimates within this factor of the threshold are near it. Sketches of 2**10 registers err by 3 %.
NEAR = 1.5
BROADCAST_LINES = 2_000_000
_SPACE = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """line (its hash) and site, for lines that are long enough."""
    line = F.explode(F.split(F.col("text"), "\n"))
    return docs.select(F.col(site).cast("string").alias("site"), line.alias("line")).filter(_long_enough("line", min_chars)).select(F.xxhash64("line").alias("line"), "site")


def _long_enough(line: str, min_chars: int):
    return F.length(F.btrim(F.col(line), F.lit(_SPACE))) >= min_chars


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The hashes of lines that occur on `min_sites` sites or more."""
    lines = _lines(docs, site, min_chars).filter("site is not null")
    # equal (line, site) pairs of a task meet before they are sketched
    once = lines.groupBy("line", "site").agg(F.lit(1).alias("one"))
    spread = once.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2)).alias("sketch"))
    spread = stage(spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= int(min_sites / NEAR)))
    near = stage(spread.filter(F.col("sites") < min_sites * NEAR).select("line"))
    exact = once.join(near, "line", "left_semi").groupBy("line").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return stage(spread.filter(F.col("sites") >= min_sites * NEAR).select("line").unionByName(exact.select("line")))


def _clean(batches: Iterator[pa.RecordBatch], gone: bytes, min_chars: int, text_column: str, counts_as: list[str]) -> Iterator[pa.RecordBatch]:
    hashes = np.frombuffer(gone, "<i8")
    known = set(hashes.tolist()) if len(hashes) <= 100_000 else None
    for b in batches:
        texts, counts, removed = [], [], []
        for text in b.column(text_column).to_pylist():
            if text is None:
                texts.append(None)
                counts.append(0)
                removed.append(0)
                continue
            lines = text.split("\n")
            h = [_hash(x) if len(x.strip(_SPACE)) >= min_chars else None for x in lines]
            if known is not None:
                out = [x is not None and x in known for x in h]
            else:
                a = np.asarray([x or 0 for x in h], np.int64)
                at = np.minimum(np.searchsorted(hashes, a), len(hashes) - 1)
                out = ((hashes[at] == a) & np.asarray([x is not None for x in h])).tolist()
            n = sum(out)
            texts.append("\n".join(x for x, o in zip(lines, out) if not o) if n else text)
            counts.append(len(lines))
            removed.append(n)
        names = b.schema.names
        columns = [pa.array(texts, pa.string()) if n == text_column else b.column(k) for k, n in enumerate(names)]
        yield batch([*names, *counts_as], [*columns, counts, removed], [*b.schema.types, pa.int64(), pa.int64()])


def _hash(line: str) -> int:
    """As the SQL function xxhash64 has it."""
    h = xxhash.xxh64_intdigest(line.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def remove_lines(docs: DataFrame, gone: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the given lines, and two more columns at the end: how many lines there were, how many left."""
    counts_as = free_names(docs.columns, "_n_lines", "_n_removed")
    text = next(c for c in docs.columns if c.lower() == "text")
    if gone.count() <= BROADCAST_LINES:
        hashes = np.sort(np.asarray([r[0] for r in gone.collect()], np.int64))
        return map_arrow(docs, partial(_clean, gone=hashes.tobytes(), min_chars=min_chars, text_column=text, counts_as=counts_as), _with_counts(docs, counts_as))
    # the row travels as one struct, so that no name of its columns can be met here
    keyed = stage(docs.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("row")))
    split = F.split(F.col("own")[text], "\n")
    lines = keyed.select("row", F.posexplode(split).alias("at", "line")).filter(_long_enough("line", min_chars)).select("row", "at", F.xxhash64("line").alias("line"))
    out = lines.join(gone, "line", "left_semi").groupBy("row").agg(F.collect_set("at").alias("out"))
    both = keyed.join(stage(out), "row", "left").withColumn("lines", split)
    kept = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains(F.coalesce("out", F.array().cast("array<int>")), i)), "\n")
    columns = [kept.alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns]
    return both.select(*columns, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias(counts_as[0]), F.when(F.col("out").isNull(), 0).otherwise(F.size("out")).cast("long").alias(counts_as[1]))


def _with_counts(docs: DataFrame, counts_as: list[str]):
    from pyspark.sql.types import LongType, StructType

    found = StructType([*docs.schema.fields])
    for c in counts_as:
        found = found.add(c, LongType())
    return found


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without boilerplate lines, with two counts of lines (before, and removed) as its last columns."""
    return remove_lines(docs, boilerplate_lines(docs, site, min_sites, min_chars), min_chars)
