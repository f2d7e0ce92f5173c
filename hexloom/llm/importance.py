"""Importance resampling with hashed n-gram generative models, sampled by Gumbel top-k (operator 1).

A document's log importance weight is the log ratio of two generative models, of target text (clean labelled
documents) and of raw text (all documents), summed over its distinct hashed n-grams: words, word pairs, the first
four and five bytes of words, and their last three. A document counts an n-gram once, in the models too, so that one
long document proves nothing.

The ratio of an n-gram is the mean of its posterior. With a share of ODDS n-grams are preferred or avoided by target
text, by a factor that is Gamma distributed; the others have the ratio 1. Target counts are Poisson around what raw
text lets expect. So rare n-grams and the common vocabulary come out near 0, and what is far from 0 is so by its
likelihood, at any size of the corpus: an n-gram that target text lacks weighs once some seven are expected.
Words and pairs are kept in two hash tables each; of both estimates the one nearer to 0 counts, so that a collision
alone never condemns.

The raw counts cover all documents. The target sample is bounded by `labelled`. The number k of documents to keep
is the number of documents over a cut, which is calibrated on a fifth of the labelled sample that no model has
seen; then the k largest of (log weight / temperature + Gumbel noise) are kept, which is sampling k documents without
replacement, each drawn in proportion to its weight (at temperature 1). The k-th largest key is found by histograms,
never by sorting or collecting the keys.

Defined results: texts without words (null ones too) have no weight and are not kept; repeated rows have equal keys
and are kept or left together (noise is a hash of doc_id and text); documents with equal keys at the cut are all kept;
a label without a document, or with a null, is left out, and of several labels of a document the worst counts;
without usable labels all documents with words are kept; very long texts are hashed in blocks, whole; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, map_arrow, row_key, text_bytes
from hexloom.llm.bytewords import WHITE_SPACE, distinct, part_hashes, separators
from hexloom.llm.counters import SCHEMA, add_up, parts_of
from hexloom.session import stage

TABLE_BITS = 20
FIRSTS, LASTS = (4, 5), (3,)
#: Which kind of n-gram each table counts: 0 words, then their parts, last the pairs.
_PAIRS = 1 + len(FIRSTS) + len(LASTS)
KINDS = (0, 0, *range(1, _PAIRS), _PAIRS, _PAIRS)
TABLES = len(KINDS)
#: The share of n-grams that target text prefers or avoids, against the others; the shape of the factors' distribution.
ODDS, SHAPE = 1e-3, 0.5
#: A share of clean documents lost weighs as much as this many times the share of others kept.
CLEAN_COUNTS = 3.0
#: Labelled documents that the target model and the cut are made from, at most.
LABELLED = 20_000
#: Log weights are divided by this before Gumbel noise is added; 1 samples in proportion to the weights.
TEMPERATURE = 1.0
PARTS = 16
BINS = 1024
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Full stops and commas part words, as white space does; other marks belong to them.
_APART = separators(WHITE_SPACE + b".,")


#: An n-gram of a batch is one number: its text's place in the batch, and below it the upper bits of its hash.
_HASH_BITS = 52
_HASH = np.uint64((1 << _HASH_BITS) - 1)


def ngrams(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct n-grams of each text of a batch (of up to 4096), by kind, as (place << 52 | hash)."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    words, *parts = part_hashes(b" ".join(texts).lower(), _APART, FIRSTS, LASTS)
    keyed = [((np.searchsorted(begins, at, "right") - 1).astype(np.uint64), h) for at, h in (words, *parts)]
    of, h = keyed[0]
    inside = of[1:] == of[:-1]
    keyed.append((of[1:][inside], (h[:-1] * _SEEDS[0] + h[1:])[inside]))
    return [distinct(of << np.uint64(_HASH_BITS) | h >> np.uint64(64 - _HASH_BITS)) for of, h in keyed]


def _slot(a: np.ndarray, k: int) -> np.ndarray:
    a = (a & _HASH) * _SEEDS[k % len(_SEEDS)] + np.uint64(k)
    a ^= a >> np.uint64(33)
    a *= _SEEDS[3]
    return (a >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts, in parts: all tables one after the other."""
    total = np.zeros((TABLES, 1 << TABLE_BITS), np.int32)  # of one task's documents
    for b in batches:
        found = ngrams(b.column(0).to_pylist())
        for k, kind in enumerate(KINDS):
            slots, n = np.unique(_slot(found[kind], k), return_counts=True)
            total[k][slots] += n.astype(np.int32)
    yield parts_of(total, PARTS * TABLES)


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """The counts of all documents: TABLES x 2**TABLE_BITS numbers, however many documents there are."""
    rows = map_arrow(docs.select(text_bytes().alias("text")), _counts, SCHEMA)
    found = add_up(rows, PARTS * TABLES)
    return (found if len(found) else np.zeros(TABLES << TABLE_BITS, np.int64)).reshape(TABLES, -1)


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(6):  # up to where the series holds
        out -= 1 / x
        x = x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The posterior mean of log p_target / p_raw, for each table's slots.

    One raw occurrence is left out: it is that of the document being scored, whose own n-grams prove nothing.
    """
    out = np.zeros(raw.shape, np.float32)
    for k in range(len(raw)):
        at = np.flatnonzero(raw[k] > 1)  # n-grams of a single document say nothing
        t = target[k][at]
        expected = (raw[k][at] - 1) * (target[k].sum() / max(1, raw[k].sum()))
        values, place = np.unique(t, return_inverse=True)
        gamma = np.asarray([math.lgamma(v + SHAPE) for v in values.tolist()])[place] - math.lgamma(SHAPE)
        # the likelihood of a preferred or avoided n-gram against that of another
        log_bayes = gamma + SHAPE * math.log(SHAPE) - (t + SHAPE) * np.log(SHAPE + expected) + expected
        sure = 1 / (1 + np.exp(-np.clip(log_bayes + math.log(ODDS), -50, 50)))
        out[k][at] = sure * (_digamma(t + SHAPE) - np.log(expected + SHAPE))
    return out


def _score(batches: Iterator[pa.RecordBatch], tables: bytes) -> Iterator[pa.RecordBatch]:
    tables = np.frombuffer(tables, np.float32).reshape(TABLES, -1)
    for b in batches:
        n = b.num_rows
        found = ngrams(b.column(2).to_pylist())
        of = [(x >> np.uint64(_HASH_BITS)).astype(np.int64) for x in found]
        weights = sum(np.bincount(o, _estimates(tables, kind, x), n) for kind, (o, x) in enumerate(zip(of, found)))
        none = np.bincount(of[0], minlength=n) == 0
        yield batch(["doc_id", "row_key", "log_weight"], [b.column(0), b.column(1), pa.array(weights, pa.float64(), mask=none)], [pa.int64(), pa.int64(), pa.float64()])


def _estimates(tables: np.ndarray, kind: int, a: np.ndarray) -> np.ndarray:
    """The ratio of each n-gram; of two estimates, the one nearer to 0."""
    best, *more = (tables[k][_slot(a, k)] for k, of in enumerate(KINDS) if of == kind)
    for other in more:
        best = np.where(np.abs(other) < np.abs(best), other, best)
    return best


def scored(docs: DataFrame, tables: np.ndarray) -> DataFrame:
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text_bytes().alias("text"))
    return map_arrow(df, partial(_score, tables=tables.tobytes()), "doc_id long, row_key long, log_weight double")


def best_cut(scores: list[tuple[float, bool]]) -> float:
    """The cut that parts clean scores from others best; ties: the lowest. Without either kind: none."""
    clean, other = sum(c for _, c in scores), sum(not c for _, c in scores)
    if not clean or not other:
        return -math.inf
    best, cut, kept_clean, kept_other = CLEAN_COUNTS - 1, -math.inf, 0, 0  # keeping all of them
    ordered = sorted(scores, reverse=True)
    for i, (s, c) in enumerate(ordered):
        kept_clean, kept_other = kept_clean + c, kept_other + (not c)
        if i + 1 < len(ordered) and ordered[i + 1][0] == s:
            continue
        gain = CLEAN_COUNTS * kept_clean / clean - kept_other / other
        if gain >= best:
            best, cut = gain, s
    return cut


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column `key`, by histograms over narrower and narrower ranges."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    if lo is None or k <= 0:
        return math.inf
    above = 0  # keys over the range
    while lo < hi:
        width = (hi - lo) / BINS
        bins = dict(keys.filter(F.col("key").between(lo, hi)).groupBy(F.least(F.lit(BINS - 1), F.floor((F.col("key") - lo) / F.lit(width)).cast("int")).alias("b")).count().collect())
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        inside = keys.filter(F.col("key").between(lo, hi) & (F.least(F.lit(BINS - 1), F.floor((F.col("key") - lo) / F.lit(width)).cast("int")) == b))
        if bins[b] <= BINS:
            return sorted((r[0] for r in inside.select("key").collect()), reverse=True)[k - above - 1]
        new = inside.agg(F.min("key"), F.max("key")).first()
        if (new[0], new[1]) == (lo, hi):
            break
        lo, hi = new
    return lo


def importance_resample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, k: int | None = None, seed: int = 7, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, row_key, log_weight, gumbel_key and kept of each document; k: how many to keep (default: by the calibrated cut)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("clean")).dropna().groupBy("doc_id").agg(F.min("clean").alias("clean"))
    known = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) > 0))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    raw = ngram_counts(docs)
    tables = log_ratios(ngram_counts(sample.filter("fit and clean")), raw)
    held = scored(sample.filter("not fit").select("doc_id", "text"), tables).filter("log_weight is not null").join(F.broadcast(known), "doc_id").select("log_weight", "clean")
    cut = best_cut([(r[0], r[1]) for r in held.collect()])
    found = stage(scored(docs, tables))
    noise = (F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = found.withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(noise)))
    keep = found.filter(F.col("log_weight") >= cut).count() if k is None else k
    least = kth_largest(keyed.select(F.col("gumbel_key").alias("key")).filter("key is not null"), keep)
    return keyed.withColumn("kept", F.coalesce(F.col("gumbel_key") >= least, F.lit(False)))
