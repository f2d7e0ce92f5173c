"""Jaccard join on word shingles by a size-aware heavy-light algorithm (operator 3).

Documents with equal shingle sets form a class; classes are what is joined. Small sets (up to a boundary) are
light: each enumerates, for every partner size, its subsets of the fixed size that the overlap must reach, and two
sets that share such a subset are linked, without any check. Large sets are heavy: inverted lists over their
prefixes (the rarest shingles of each set, as many as a linked set cannot avoid) are scanned, and candidates are
checked exactly. The boundary is where the estimated cost of both parts is smallest.

Components, not pairs, are wanted, so that a list is not expanded into all its pairs. Its first member (the one
with the fewest rarer shingles) is compared with all others; linked classes are contracted; a list goes on with
its next members only while the rest of it belongs to different components. A member is compared with all members
of other components in the end, so no link between different texts is lost.

Shingles are 64-bit hashes. Lists of very frequent shingles are salted by the counts of a sketch over all
documents, of fixed size; it also gives the order of shingles, which decides speed and never results.

Defined results: null texts and texts without words have no shingles and are linked with nothing; texts of fewer
than `width` words are one shingle; repeated rows get a row each and are copies of each other; rows without a doc_id
link as others do, and a component in which no row has one has a null component_id; very long texts are hashed in
blocks and compared whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, map_arrow, row_key, text_bytes
from hexloom.llm.bytewords import WHITE_SPACE, distinct, separators, word_hashes
from hexloom.llm.components import connected_components
from hexloom.llm.counters import add_up, parts_of
from hexloom.session import shuffle_partitions, stage

WIDTH = 5
#: The similarity bound, as a fraction.
NUM, DEN = 4, 5
#: Largest light set that is ever considered, and the size up to which a set's shingles are kept with its row.
MOST_LIGHT = 16
KEPT = MOST_LIGHT * DEN // NUM
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: A list expected to be longer than this is salted.
LIST_ROWS = 20_000
#: A list with no more members than this is compared in full; of a longer one, so many members go at once.
SMALL_LIST = 2048
FIRST_MEMBERS = 512
#: Parity bits per set, in longs: sets differ in at least as many shingles as their bits differ.
BIT_WORDS = 8
#: Rows that a task gathers before it gives them out.
MOST_ROWS = 100_000
#: Ids, of 8 bytes, that may be broadcast.
BROADCAST_IDS = 1_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SPACE = separators(WHITE_SPACE)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a whole text."""
    a = word_hashes(text.lower(), _SPACE)  # of bytes: A-Z only
    if len(a) < width:
        return np.asarray([xxhash.xxh3_64_intdigest(a.tobytes(), seed=len(a))] if len(a) else [], np.uint64)
    n = len(a) - width + 1
    s = a[:n] * _MIX[0]
    for k in range(1, width):
        s += a[k : k + n] * (_MIX[k % 5] + np.uint64(2 * (k // 5)))
    s ^= s >> np.uint64(32)
    s *= _MIX[3]
    s ^= s >> np.uint64(29)
    return distinct(s)


def needed_overlap(a: int, b: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def fits(a: int, b: int) -> bool:
    return DEN * min(a, b) >= NUM * max(a, b)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


_BITS = [f"b{k}" for k in range(BIT_WORDS)]
_SETS = "doc_id long, row_key long, n long, fp long, small array<long>, " + "".join(f"{c} long, " for c in _BITS) + "part int, level long, counts binary"
_SET_NAMES = [c.split()[0] for c in _SETS.split(", ")]
_SET_TYPES = [*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.int64()] * BIT_WORDS, pa.int32(), pa.int64(), pa.binary()]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the task's sketch, in parts."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        sizes, prints, small = [], [], []
        bits = np.zeros((b.num_rows, BIT_WORDS), np.int64)
        for i, text in enumerate(b.column(2)):
            s = shingles(text.as_py(), width)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
            small.append(s.view(np.int64) if len(s) <= KEPT else None)
            odd = np.bincount((s % np.uint64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
            bits[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1  # equal places within a text count once
        nothing = [None] * len(sizes)
        yield batch(_SET_NAMES, [b.column(0), b.column(1), sizes, prints, small, *np.ascontiguousarray(bits.T), *[nothing] * 3], _SET_TYPES)
    parts = parts_of(sketch, SKETCH_PARTS)
    yield batch(_SET_NAMES, [*[[None] * SKETCH_PARTS] * (5 + BIT_WORDS), *parts.columns], _SET_TYPES)


def boundary(histogram: dict[int, int]) -> int:
    """The size up to which sets are light: where the estimated costs of both parts sum to least.

    A subset costs 1 (a row to shuffle); a posting of a heavy set costs 2 (it is also sorted) and the check of its
    candidates about as much as its shingles.
    """

    def light(x: int) -> int:
        return sum(k * sum(comb(n, needed_overlap(n, m)) for m in _partners(n, x)) for n, k in histogram.items() if n <= x * DEN // NUM)

    def heavy(x: int) -> int:
        return sum(k * (2 * prefix_length(n) + n) for n, k in histogram.items() if n > x)

    return min(range(NUM, MOST_LIGHT + 1), key=lambda x: (light(x) + heavy(x), x))


def _partners(n: int, x: int) -> list[int]:
    """The partner sizes for which a set of n shingles enumerates subsets: the smaller of both is light."""
    return [m for m in range(1, KEPT + 1) if fits(n, m) and min(n, m) <= x]


def _subsets(batches: Iterator[pa.RecordBatch], x: int) -> Iterator[pa.RecordBatch]:
    """(subset, set, role) rows, given out as they pile up: a set may have thousands of subsets."""
    types = [pa.int64(), pa.int64(), pa.int32()]
    for b in batches:
        out: tuple[list, list, list] = ([], [], [])
        for fp, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = np.sort(np.asarray(s, np.int64))
            for m in _partners(len(s), x):
                a, c = min(len(s), m), max(len(s), m)
                keys = [xxhash.xxh3_64_intdigest(s[list(subset)].tobytes(), seed=a * 64 + c) - (1 << 63) for subset in combinations(range(len(s)), needed_overlap(a, c))]
                for have, new in zip(out, (keys, [fp] * len(keys), [(len(s) > m) - (len(s) < m)] * len(keys))):
                    have += new
            if len(out[0]) > MOST_ROWS:
                yield batch(["key", "fp", "role"], list(out), types)
                out = ([], [], [])
        yield batch(["key", "fp", "role"], list(out), types)


def light_links(sets: DataFrame, x: int) -> DataFrame:
    """Edges among sets of which the smaller has at most x shingles. Sets that share a subset are all linked."""
    sets = sets.filter(F.col("n").between(1, x * DEN // NUM)).select("fp", "small").distinct()
    found = stage(map_arrow(sets, partial(_subsets, x=x), "key long, fp long, role int"))
    least = found.groupBy("key").agg(F.min(F.when(F.col("role") <= 0, F.col("fp"))).alias("lower"), F.min(F.when(F.col("role") >= 0, F.col("fp"))).alias("upper"), F.max("fp").alias("other"))
    least = stage(least.filter("lower is not null and upper is not null and (lower <> upper or other <> lower)").drop("other"), rows=found.count())
    return found.join(least, "key").select(F.col("fp").alias("u"), F.when(F.col("role") < 0, F.col("upper")).otherwise(F.col("lower")).alias("v")).filter("u <> v").distinct()


def _postings(batches: Iterator[pa.RecordBatch], width: int, x: int, counts: bytes) -> Iterator[pa.RecordBatch]:
    """The prefix of each heavy set: token, salt, set, its size and the place in the prefix. Copies in a task go once."""
    sketch = np.frombuffer(counts, "<i4")
    seen: set[int] = set()
    for b in batches:
        tokens, salts, prints, sizes, places = [], [], [], [], []
        for text in b.column(0):
            s = shingles(text.as_py(), width)
            if len(s) <= x:
                continue
            fp = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
            if fp in seen:
                continue
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(fp)
            c = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.argsort(c, kind="stable")[: prefix_length(len(s))]
            tokens.append(s[order].view(np.int64))
            parts = -(-c[order].astype(np.int64) // LIST_ROWS)
            salts.append(np.where(parts > 1, np.abs(fp) % np.maximum(parts, 1), -1))
            prints.append(np.full(len(order), fp, np.int64))
            sizes.append(np.full(len(order), len(s), np.int32))
            places.append(np.arange(len(order), dtype=np.int32))
        join = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
        yield batch(["token", "salt", "fp", "n", "u"], [join(tokens, np.int64), join(salts, np.int32), join(prints, np.int64), join(sizes, np.int32), join(places, np.int32)], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()])


_LIST = ["token", "fp", "n", "u", "rep", "rep_n", "rep_u"]
_LIST_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks lists sorted by (token, salt, u, fp); keeps those with different sets, each row with its list's first.

    A row is left out if not even the first member, which has the fewest rarer shingles, could be similar enough.
    Only one row is held, however long a list is.
    """
    first = None  # of the list that goes on: (token, salt, fp, n, u), and whether it has been given out
    given = False
    for b in batches:
        if not b.num_rows:
            continue
        t, salt, fp, n, u = (b.column(k).to_numpy(zero_copy_only=False) for k in ("token", "salt", "fp", "n", "u"))
        begins = np.empty(len(t), bool)
        begins[0] = first is None or (t[0], salt[0]) != first[:2]
        begins[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
        lead = np.maximum.accumulate(np.where(begins, np.arange(len(t)), -1))
        old = lead < 0
        k = np.maximum(lead, 0)
        rep, rep_n, rep_u = (np.where(old, np.int64(first[i] if first else 0), a[k].astype(np.int64)) for i, a in ((2, fp), (3, n), (4, u)))
        copy = np.zeros(len(t), bool)
        copy[1:] = (fp[1:] == fp[:-1]) & ~begins[1:]
        copy |= fp == rep
        other = ~begins & ~copy
        n64, u64 = n.astype(np.int64), u.astype(np.int64)
        other &= (salt >= 0) | (DEN * (n64 - u64) >= NUM * (n64 + rep_u))
        # the first members of lists that have others
        with_others = np.zeros(len(t), bool)
        with_others[lead[other & ~old]] = True
        with_others |= begins & (salt >= 0)
        out = [np.concatenate(x) for x in zip(*[(a[m] for a in (t, fp, n, u, rep, rep_n, rep_u)) for m in (with_others, other)])]
        if first is not None and not given and (other & old).any():
            out = [np.append(a, v) for a, v in zip(out, (first[0], first[2], first[3], first[4], first[2], first[3], first[4]))]
        at = int(lead[-1])
        if at >= 0:
            first, given = (t[at], salt[at], fp[at], n[at], u[at]), bool(with_others[at])
        else:
            given = given or bool((other & old).any())
        yield batch(_LIST, [np.asarray(a).astype(ty.to_pandas_dtype()) for a, ty in zip(out, _LIST_TYPES)], _LIST_TYPES)


def _possible(n: str, u: str, m: str, v: str):
    """Whether sets of sizes n and m, whose first common shingle is at places u and v, can be similar enough."""
    both = F.expr(f"{DEN} * least({n}, {m}) >= {NUM} * greatest({n}, {m})")
    return both & F.expr(f"{NUM + DEN} * least({n} - {u}, {m} - {v}) >= {NUM} * ({n} + {m})")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct()


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets of wanted texts, a few at a time: a long text has a large one."""
    for b in batches:
        held, size = [], 0
        for k, text in enumerate(b.column(1)):
            held.append(shingles(text.as_py(), width).view(np.int64))
            size += len(held[-1])
            if size > 4 * MOST_ROWS or k == b.num_rows - 1:
                yield batch(["fp", "s"], [b.column(0).slice(k + 1 - len(held), len(held)), held], [pa.int64(), pa.list_(pa.int64())])
                held, size = [], 0


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, rows: int) -> DataFrame:
    """The linked ones of pairs (u, v) of classes, by the exact intersection of their shingles.

    Pairs whose parity bits differ too much are left out before a text is fetched. Of each class one text is read,
    that with its smallest row key; rows that repeat it are told from it by nothing and go. rows: how many pairs
    there are at most.
    """
    bits = classes.select("fp", "n", *_BITS)
    with_bits = pairs.join(bits.select(F.col("fp").alias("u"), "n", *_BITS), "u").join(bits.select(F.col("fp").alias("v"), F.col("n").alias("n2"), *(F.col(c).alias(f"{c}2") for c in _BITS)), "v")
    pairs = stage(with_bits.filter(_near_bits()).select("u", "v"), rows=rows)
    rows = pairs.count()
    if not rows:
        return pairs
    wanted = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    wanted = stage(classes.join(wanted, "fp", "left_semi").select("fp", "row_key"), rows=2 * rows)
    n = wanted.count()
    texts = docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "row_key").select("fp", "text")
    sets = stage(map_arrow(texts, partial(_arrays, width=width), "fp long, s array<long>"))
    if sets.count() > n:
        sets = stage(sets.dropDuplicates(["fp"]))
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return stage(both.filter((NUM + DEN) * common >= NUM * (F.size("a") + F.size("b"))).select("u", "v"), rows=rows)


def _near_bits():
    """Whether the parity bits of sets of n and n2 shingles allow a link: linked sets differ in (n + n2) / 9 of them at most."""
    apart = " + ".join(f"bit_count({c} ^ {c}2)" for c in _BITS)
    return F.expr(f"{NUM + DEN} * ({apart}) <= {DEN - NUM} * (n + n2)")


def heavy_links(docs: DataFrame, classes: DataFrame, x: int, counts: bytes, width: int, links: DataFrame) -> DataFrame:
    """Edges enough to connect all linked classes of more than x shingles; `links` are edges known before."""
    rows = map_arrow(docs.select("text"), partial(_postings, width=width, x=x, counts=counts), "token long, salt int, fp long, n int, u int")
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "token", "salt").sortWithinPartitions("token", "salt", "u", "fp")
    lists = stage(map_arrow(rows, _scan, "token long, fp long, n int, u int, rep long, rep_n int, rep_u int"))
    size = lists.count()
    first = lists.filter(_possible("n", "u", "rep_n", "rep_u"))
    links = links.unionByName(verified(_pairs(first, "fp", "rep"), classes, docs, width, size))
    # what is left of a list has been compared with its first member
    rest = stage(lists.filter("fp <> rep").select("token", "fp", "n", "u").unionByName(_sub_firsts(lists)).distinct(), rows=size)
    known = links.count()
    labels = stage(connected_components(links, known), rows=2 * known)
    near = _possible("n", "u", "n2", "u2") & _near_bits()
    while True:
        own = rest.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        own = _mixed(_mixed(stage(own, rows=size), size), size)
        size = own.count()
        if not size:
            return links
        own = own.join(classes.select("fp", *_BITS), "fp")
        short, long = own.filter(F.col("members") <= SMALL_LIST), own.filter(F.col("members") > SMALL_LIST)
        other = short.select("token", *(F.col(c).alias(f"{c}2") for c in ("fp", "n", "u", "component", *_BITS)))
        found = stage(_pairs(short.join(other, "token").filter("component < component2").filter(near), "fp", "fp2"), rows=size)
        lead = long.groupBy("token", F.pmod(F.xxhash64("fp"), F.lit(FIRST_MEMBERS)).alias("k")).agg(F.min(F.struct("u", "fp", "n", "component", *_BITS)).alias("f"))
        lead = stage(lead.select("token", F.col("f.fp").alias("fp2"), F.col("f.n").alias("n2"), F.col("f.u").alias("u2"), F.col("f.component").alias("component2"), *(F.col(f"f.{c}").alias(f"{c}2") for c in _BITS)), rows=size)
        more = not lead.isEmpty()
        if more:
            found = stage(found.unionByName(_pairs(long.join(lead, "token").filter("component <> component2").filter(near), "fp", "fp2")).distinct(), rows=size)
            rest = stage(long.join(lead.select("token", F.col("fp2").alias("fp")), ["token", "fp"], "left_anti").select("token", "fp", "n", "u"), rows=size)
        new = verified(found, classes, docs, width, found.count())
        added = new.count()
        if added:
            known += added
            links = stage(links.unionByName(new), rows=known)
            labels = stage(connected_components(links, known), rows=2 * known)
        if not more:
            return links


def _mixed(own: DataFrame, rows: int) -> DataFrame:
    """The members of lists that span components, without those that not even the list's least place lets in."""
    lists = own.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("a"), F.max("component").alias("b"), F.min("u").alias("least")).filter("a <> b")
    lists = stage(lists.select("token", "members", "least"), rows=rows)
    return stage(own.drop("members").join(lists, "token").filter(F.expr(f"{DEN} * (n - u) >= {NUM} * (n + least)")).drop("least"), rows=rows)


def _sub_firsts(lists: DataFrame) -> DataFrame:
    """The first members of the parts of salted lists: parts have yet to be compared with each other."""
    firsts = lists.filter("fp = rep").select("token", "fp", "n", "u")
    salted = stage(firsts.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token"))
    return firsts.join(salted, "token", "left_semi")


def similarity_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), row_key and is_first of each document.

    row_key is a hash of doc_id and text; is_first tells the row that stands for its component: the one with the
    smallest (doc_id, row_key), null ids last. Equal rows are first together.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text_bytes().alias("text"))
    both = stage(map_arrow(docs, partial(_sets, width=width), _SETS))
    sets = both.filter("part is null").drop("part", "level", "counts")
    # 4 MiB, however many documents there are
    counts = np.minimum(add_up(both.filter("part is not null").select("part", "level", "counts"), SKETCH_PARTS), 2**31 - 1).astype("<i4").tobytes()
    size = sets.count()
    classes = stage(sets.filter("n > 0").groupBy("fp").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("first"), F.max("n").alias("n"), *(F.max(c).alias(c) for c in _BITS)), rows=size)
    x = boundary({r[0]: r[1] for r in classes.filter(F.col("n") <= KEPT).groupBy("n").count().collect()})
    links = light_links(sets, x)
    if counts:
        links = heavy_links(docs, classes, x, counts, width, stage(links))
    links = stage(links)
    known = links.count()
    labels = stage(connected_components(links, known), rows=2 * known)
    own = stage(classes.select("fp", "first").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), rows=size)
    names = stage(own.groupBy("component").agg(F.min("first").alias("component_id")), rows=size)
    named = stage(own.join(names, "component").select("fp", "component", "component_id"), rows=size)
    rows = sets.select("doc_id", "row_key", "n", "fp").join(named, "fp", "left")
    # of the rows with a component's smallest doc_id (of all its rows, where none has one) the smallest key stands for it
    leads = rows.filter("n > 0 and doc_id <=> component_id").groupBy("component").agg(F.min("row_key").alias("lead"))
    rows = stage(rows, rows=size).join(stage(leads, rows=size), "component", "left")
    has = F.col("n") > 0
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", (~has | ((F.col("row_key") == F.col("lead")) & F.col("doc_id").eqNullSafe(F.col("component_id")))).alias("is_first"))
