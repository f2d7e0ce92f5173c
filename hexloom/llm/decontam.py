"""Benchmark decontamination by a distributed positional inverted index (operator 8).

The index is partitioned by documents and knows nothing of any benchmark: each segment (a batch of documents) stores
all terms of its documents (64-bit hashes of words, sorted) and, for each, the positions at which the segment has it;
documents lie one after the other with a gap between them. positional_index() builds it once; search() answers any
number of benchmarks from it.

Terms of a benchmark are ordered by their counts over the whole corpus, which are taken from the index. A window of
consecutive benchmark words starts from the list of its rarest term, shifted by the term's offset, and is intersected
with the shifted lists of its next rarest terms until the list is empty or all terms have been met: what remains are
exact phrase matches. With a slop, lists are intersected by ranges and the rest is checked word by word: proximity
matches in order.

A benchmark travels to all tasks in blocks of about BLOCK_WORDS words; one block is the usual case, more blocks mean
more passes over the index, each bounded in memory: items longer than ITEM_WORDS words are cut into overlapping parts
first, so that no single item fills a block.

Words are compared by their hashes: a window of ten words would have to collide in each of them. For items of one
word, a wrong match is expected once in 2**64 pairs of different words.

Defined results: null texts and texts without words have no words, no hits and no items; items without words give
no window; repeated items count once, repeated documents get a row each; items without an id have windows, which hit
but name no item; very long texts are hashed in blocks, whole; an empty benchmark leaves all documents clean; an empty
documents table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, map_arrow, row_key, text_bytes
from hexloom.llm.bytewords import separators, word_hashes
from hexloom.session import stage

WINDOW = 10
BLOCK_WORDS, ITEM_WORDS = 500_000, 10_000
#: ASCII beyond letters and digits separates words; all other bytes belong to them.
_APART = separators(bytes(b for b in range(128) if not chr(b).isalnum()))

INDEX_SCHEMA = "doc_ids array<long>, row_keys array<long>, rows array<long>, lengths array<int>, terms binary, counts binary, positions binary"
HIT_SCHEMA = "doc_id long, row_key long, row long, n_words long, runs array<struct<start:int,end:int>>, items array<long>"
#: Windows and the ids of their items: a window is a tuple of term hashes.
Windows = dict[tuple[int, ...], set[int | None]]


def terms_of(text: bytes) -> np.ndarray:
    """The hashes of a text's words, A-Z in lower case."""
    return word_hashes(text.lower(), _APART)


def windows_of(items: list[tuple[int | None, bytes]], window: int = WINDOW) -> Windows:
    """The items of each distinct window."""
    found: Windows = {}
    for item_id, words in items:
        words = np.frombuffer(words, np.uint64).tolist()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item_id)
    return found


def _items(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item_id, words): the term hashes of items, long ones in parts that share window - 1 words."""
    for b in batches:
        for item_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = terms_of(text.as_py())
            parts = [words[i : i + ITEM_WORDS + window - 1] for i in range(0, max(1, len(words) - window + 1), ITEM_WORDS)] if len(words) else []
            yield batch(["item_id", "words"], [[item_id] * len(parts), [p.tobytes() for p in parts]], [pa.int64(), pa.binary()])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        words = [terms_of(t.as_py()) for t in b.column(3)]
        lengths = np.asarray(list(map(len, words)), np.int64)
        a = np.concatenate(words)
        at = np.arange(len(a)) + np.repeat(np.arange(len(words)), lengths)  # a gap after each document
        order = np.argsort(a, kind="stable")
        a, at = a[order], at[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        begins = np.flatnonzero(first)
        steps = np.diff(at, prepend=0)  # positions of a term as steps, which compress better
        steps[begins] = at[begins]
        names = ["doc_ids", "row_keys", "rows", "lengths", "terms", "counts", "positions"]
        values = [[b.column(k).to_pylist()] for k in range(3)] + [[lengths], [a[begins].tobytes()], [np.diff(np.append(begins, len(a))).astype("<i4").tobytes()], [steps.astype("<i4").tobytes()]]
        yield batch(names, values, [*[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), *[pa.binary()] * 3])


def positional_index(docs: DataFrame) -> DataFrame:
    """The index, written to shared storage: a row per segment with its documents, terms and positions."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    return stage(map_arrow(df, _index, INDEX_SCHEMA))


class Segment:
    """One row of the index; a term's list is unpacked when it is asked for."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes | None = None):
        self.terms, self.counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, "<i4")
        if positions is not None:
            self.ends = np.cumsum(self.counts)
            self.steps = np.frombuffer(positions, "<i4")
            self.known: dict[int, np.ndarray | None] = {}

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted terms the segment has, and where in its list of terms."""
        if not len(self.terms):
            return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        has = self.terms[at] == wanted
        return has, at[has]

    def get(self, term: int) -> np.ndarray | None:
        if term not in self.known:
            has, at = self.places(np.asarray([term], np.uint64))
            self.known[term] = np.cumsum(self.steps[self.ends[at[0]] - self.counts[at[0]] : self.ends[at[0]]], dtype=np.int64) if has[0] else None
        return self.known[term]


def _term_counts(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """A task's counts of the wanted terms (sorted), by their numbers."""
    terms = np.frombuffer(wanted, np.uint64)
    total = np.zeros(len(terms), np.int64)
    for b in batches:
        for t, c in zip(b.column(0), b.column(1)):
            s = Segment(t.as_py(), c.as_py())
            has, at = s.places(terms)
            total[has] += s.counts[at]
    at = np.flatnonzero(total)
    yield batch(["term", "n"], [at, total[at]], [pa.int64(), pa.int64()])


def _within(post: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the ranges lo..hi hold a position of the list."""
    return np.searchsorted(post, hi, "right") > np.searchsorted(post, lo, "left")


def phrase_starts(lists: Segment, window: tuple[int, ...], order: list[int]) -> np.ndarray:
    """Starts of a window: its lists, adjusted by their offsets, intersected in the order given."""
    starts = lists.get(window[order[0]]) - order[0]
    for o in order[1:]:
        if not len(starts):
            break
        post = lists.get(window[o])
        if post is None:
            return starts[:0]
        at = np.searchsorted(post, starts + o)
        starts = starts[post[np.minimum(at, len(post) - 1)] == starts + o]
    return starts


def proximity_spans(segment: Segment, window: tuple[int, ...], order: list[int], slop: int) -> list[tuple[int, int]]:
    """(start, end) of places that have the window's words in order, with at most `slop` other words between them."""
    lists = {t: segment.get(t) for t in window}
    if any(x is None for x in lists.values()):
        return []
    rare, length = order[0], len(window)
    centres = lists[window[rare]]
    for o in order[1:]:
        lo, hi = (centres + 1, centres + (o - rare) + slop) if o > rare else (centres - (rare - o) - slop, centres - 1)
        centres = centres[_within(lists[window[o]], lo, hi)]
    found = set()
    for c in centres.tolist():
        first = lists[window[0]]
        for s in first[np.searchsorted(first, c - rare - slop) : np.searchsorted(first, c - rare, "right")].tolist():
            at = s
            for t in window[1:]:  # the earliest next place is never worse
                k = int(np.searchsorted(lists[t], at + 1))
                if k == len(lists[t]) or lists[t][k] - s >= length + slop:
                    break
                at = int(lists[t][k])
            else:
                found.add((s, at + 1))
    return sorted(found)


def _search(batches: Iterator[pa.RecordBatch], by_rarest: dict[int, list], slop: int) -> Iterator[pa.RecordBatch]:
    rarest = np.asarray(sorted(by_rarest), np.uint64)
    for b in batches:
        for seg in (x for k in range(b.num_rows) for x in b.slice(k, 1).to_pylist()):
            lists = Segment(seg["terms"], seg["counts"], seg["positions"])
            lengths = np.asarray(seg["lengths"], np.int64)
            bases = np.concatenate([[0], np.cumsum(lengths + 1)])
            spans: list[list] = [[] for _ in seg["doc_ids"]]
            items: list[set] = [set() for _ in seg["doc_ids"]]
            for t in rarest[lists.places(rarest)[0]].tolist():
                for window, order, of in by_rarest[t]:
                    if slop:
                        places = proximity_spans(lists, window, order, slop)
                    else:
                        places = [(s, s + len(window)) for s in phrase_starts(lists, window, order).tolist()]
                    for s, e in places:
                        d = int(np.searchsorted(bases, s, "right")) - 1
                        if e <= bases[d] + lengths[d]:
                            spans[d].append((s - int(bases[d]), e - int(bases[d])))
                            items[d] |= of
            yield batch(
                ["doc_id", "row_key", "row", "n_words", "runs", "items"],
                [seg["doc_ids"], seg["row_keys"], seg["rows"], seg["lengths"], [[{"start": s, "end": e} for s, e in merged(x)] for x in spans], [sorted(x - {None}) for x in items]],
                [*[pa.int64()] * 4, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())],
            )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as sorted runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = [merged([(r["start"], r["end"]) for r in x or ()]) for x in b.column("runs").to_pylist()]
        hits = [sum(e - s for s, e in x) for x in runs]
        items = [sorted(map(str, set(x or ()))) for x in b.column("items").to_pylist()]
        yield batch(
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "row_key"],
            [b.column("doc_id"), b.column("n_words"), hits, list(map(len, items)), [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [n > 0 for n in hits], b.column("row_key")],
            [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()],
        )


DIGEST_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, row_key long"


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, row_key, row, n_words, runs (of hit words) and items (with occurring windows) of each indexed document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
    items = stage(map_arrow(items, partial(_items, window=window), "item_id long, words binary"))
    size = items.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-size // block_words))
    parts = []
    for k in range(blocks):
        of = windows_of([(r[0], bytes(r[1])) for r in items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()], window)
        terms = np.asarray(sorted({t for w in of for t in w}), np.uint64)
        found = map_arrow(index.select("terms", "counts"), partial(_term_counts, wanted=terms.tobytes()), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        counts = {int(terms[r[0]]): r[1] for r in found}
        by_rarest: dict[int, list] = {}
        for w, ids in of.items():
            order = sorted(range(len(w)), key=lambda i: (counts.get(w[i], 0), i))
            if counts.get(w[order[0]]):
                by_rarest.setdefault(w[order[0]], []).append((w, order, ids))
        parts.append(map_arrow(index, partial(_search, by_rarest=by_rarest, slop=slop), HIT_SCHEMA))
    if blocks == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """search() over an index of these documents."""
    return search(positional_index(docs), benchmark, window, slop, block_words)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and row_key of what search() has found."""
    return map_arrow(found.select("doc_id", "row_key", "n_words", "runs", "items"), _digest, DIGEST_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """digest() of the benchmark's windows in these documents."""
    return digest(benchmark_matches(docs, benchmark, window))
