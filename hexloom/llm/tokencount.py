"""Exact token counts at every prefix of a text, by prefix dynamic programming (operator 5).

A BPE encoding without its last token is the encoding of the shorter text. So the encoding of a prefix of length i
ends in the one token t for which (last token of prefix i - len(t), t) is a pair that BPE leaves apart, and the
count at i is the count at i - len(t), plus one. The word-level vocabulary marks the end of a word, so there are
two tables for each word: one for prefixes inside the word, one for prefixes that end there. Tables of words are
stored (in a bounded cache); the table of a text is the running sum over its words, plus the table of the word
that a prefix cuts; prefix_tables() stores it at every prefix (where the count changes), and count_at() and
within_budget() answer truncation and budget questions from it by DataFrame functions, without encoding again.

Words are the library's own pre-tokens, in any script. Where a prefix does not split as the whole does (special
strings, and texts whose normal form moves code points, such as separate accents), prefixes are encoded by the
library: a few near the budget's place for one budget, all of one chunk between white space for a table.

Defined results: a null text counts as empty (0 tokens); repeated rows give repeated results; an empty table gives
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from hexloom.llm.arrow import batch, map_arrow, text_bytes
from hexloom.llm.wordbpe import _KEY, Generations, word_bpe

TOKEN_LIMIT = 2048
#: Tokens and code points around a budget's place in which a prefix's end is looked for where tables do not hold.
NEAR = 64
_CHUNK = re.compile(rb"[^ \t-\r]+")
_END = "</w>"


class PrefixCounts:
    """Prefix tables over one vocabulary; one instance for each worker."""

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers

        self.bpe = word_bpe(path)
        with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocabulary = frozenset(model["vocab"])
        self.longest = max(len(x.removesuffix(_END)) for x in self.vocabulary)
        self.inside = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])
        self.finder = ahocorasick.Automaton()
        for x in self.vocabulary:
            if not x.endswith(_END):
                self.finder.add_word(x, x)
        self.finder.make_automaton()
        self.apart: dict[tuple[str, str], bool] = {}
        self.words = Generations()
        self.totals = Generations()

    def stays_apart(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            ends = b.endswith(_END)
            tokens = (self.bpe.model if ends else self.inside).tokenize(a + b.removesuffix(_END))
            found = self.apart[key] = len(tokens) == 2 and tokens[0].value == a and tokens[1].value == b
        return found

    def inner_table(self, word: str) -> tuple[list[int], list[str]]:
        """For each prefix of a word, in the byte-level alphabet and taken as going on: its token count and last token."""
        known, stays_apart = self.apart.get, self.stays_apart
        count, last, done = [0] * (len(word) + 1), [""] * (len(word) + 1), 0
        for end, t in self.finder.iter(word):
            end += 1
            if end == done:
                continue
            at = end - len(t)
            if at:
                pair = (last[at], t)
                ok = known(pair)
                if not (stays_apart(*pair) if ok is None else ok):
                    continue
            count[end], last[end], done = count[at] + 1, t, end
        return count, last

    def ending(self, word: str, i: int, count: list[int], last: list[str]) -> int:
        """The token count of the first i units of a word, taken as ending there."""
        for j in range(max(0, i - self.longest), i):
            t = word[j:i] + _END
            if t in self.vocabulary and (j == 0 or self.stays_apart(last[j], t)):
                return count[j] + 1
        raise ArithmeticError(f"no token ends at {i} of {word!r}")

    def piece_total(self, piece: str) -> int:
        """The count of a whole pre-token: the last entry of its table."""
        found = self.words.get(piece)
        if found is None:
            word = self.bpe.alphabet(piece)
            found = 1 if word + _END in self.vocabulary else self.ending(word, len(word), *self.inner_table(word))
            if len(piece) <= _KEY:
                self.words.put(piece, found)
        return found

    def piece_table(self, piece: str) -> list[int]:
        """The counts at each code point of a pre-token."""
        word = self.bpe.alphabet(piece)
        count, last = self.inner_table(word)
        at = accumulate((len(c.encode()) for c in piece), initial=0)
        return [self.ending(word, i, count, last) if i else 0 for i in at]

    def chunk_total(self, chunk: bytes) -> int:
        text = chunk.decode("utf-8", "replace")
        pieces = self.bpe.pieces_of(text)
        found = len(self.bpe.library_ids(text)) // 4 if pieces is None else sum(map(self.piece_total, pieces))
        if len(chunk) <= _KEY:
            self.totals.put(chunk, found)
        return found

    def chunk_table(self, chunk: bytes) -> list[int] | None:
        """The counts at each code point of a chunk (0 first), or None where normalisation moves code points or a
        special string is in the chunk."""
        text = chunk.decode("utf-8", "replace")
        low = self.bpe.tokenizer.normalizer.normalize_str(text)
        if len(low) != len(text) or "<|" in text or any(map(unicodedata.combining, text)):
            return None
        table = [0]
        for word, (start, end) in self.bpe.tokenizer.pre_tokenizer.pre_tokenize_str(low):
            piece, spent = low[start:end], table[-1]
            counts = self.piece_table(piece)
            if len(piece) > 2 and piece.startswith("'") and piece[1:].isalpha():
                # a prefix that cuts a contraction of two letters is an apostrophe and a letter
                counts = [0, counts[1], counts[1] + self.piece_total(piece[1]), counts[-1]]
            table += [spent + n for n in counts[1:]]
        return table if len(table) == len(text) + 1 else None

    def chunk_within(self, chunk: bytes, budget: int) -> int:
        """Code points of the longest prefix of a chunk that has at most `budget` tokens."""
        table = self.chunk_table(chunk)
        if table is not None:
            return max(i for i, n in enumerate(table) if n <= budget)
        # beyond the last whole token a prefix has those of the whole, so that its end lies near the budget's token
        text = chunk.decode("utf-8", "replace")
        spans = self.bpe.tokenizer.encode(text, add_special_tokens=False).offsets
        hi = min(len(text), spans[min(len(spans) - 1, budget + NEAR)][1] + NEAR) if spans else len(text)
        return next(i for i in range(hi, -1, -1) if len(self.bpe.library_ids(text[:i])) <= 4 * budget)

    def text_table(self, text: bytes) -> tuple[list[int], list[int]]:
        """The stored table of a text: code points after which the count changes, and the counts from there on."""
        ends, counts, spent, at, done = [0], [0], 0, 0, 0
        for m in _CHUNK.finditer(text):
            at += len(text[done : m.start()].decode("utf-8", "replace"))
            size = len(m[0].decode("utf-8", "replace"))
            table = self.chunk_table(m[0])
            if table is None:
                decoded = m[0].decode("utf-8", "replace")
                table = [len(self.bpe.library_ids(decoded[:i])) // 4 for i in range(size + 1)]
            for i, n in enumerate(table[1:], 1):
                if spent + n != counts[-1]:
                    ends.append(at + i)
                    counts.append(spent + n)
            spent, at, done = spent + table[-1], at + size, m.end()
        return ends, counts

    def counts(self, text: bytes) -> list[int]:
        """The counts of a text's chunks."""
        chunks = text.split()
        out = list(map(self.totals.young.get, chunks))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    found = self.totals.get(chunks[i])
                    out[i] = self.chunk_total(chunks[i]) if found is None else found
        return out

    def within(self, text: bytes, budget: int) -> int:
        """Code points of the longest prefix of a text that has at most `budget` tokens."""
        spent = 0
        for m, n in zip(_CHUNK.finditer(text), self.counts(text)):
            if spent + n > budget:
                return len(text[: m.start()].decode("utf-8", "replace")) + self.chunk_within(m[0], budget - spent)
            spent += n
        return len(text.decode("utf-8", "replace"))


_own: dict[str | None, PrefixCounts] = {}


def prefix_counts(path: str | None = None) -> PrefixCounts:
    if path not in _own:
        _own[path] = PrefixCounts(path)
    return _own[path]


def _count(batches: Iterator[pa.RecordBatch], path: str | None, limit: int) -> Iterator[pa.RecordBatch]:
    p = prefix_counts(path)
    for b in batches:
        texts = b.column(1).to_pylist()
        n = [sum(p.counts(t)) for t in texts]
        yield batch(
            ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            [b.column(0), list(map(len, texts)), n, [x > limit for x in n], [p.within(t, limit) if x > limit else len(t.decode("utf-8", "replace")) for t, x in zip(texts, n)]],
            [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()],
        )


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and limit_chars: the code points of the longest prefix within the limit."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_arrow(df, partial(_count, path=tokenizer_path, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def _tables(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    p = prefix_counts(path)
    for b in batches:
        texts = b.column(1).to_pylist()
        tables = list(map(p.text_table, texts))
        yield batch(["doc_id", "places", "counts"], [b.column(0), [x for x, _ in tables], [x for _, x in tables]], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())])


def prefix_tables(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, places and counts: the stored table of each text. A prefix of i code points has the count that stands
    beside the last place that is not over i; places where the count stays are left out."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_arrow(df, partial(_tables, path=tokenizer_path), "doc_id long, places array<int>, counts array<int>")


def count_at(tables: DataFrame, chars) -> DataFrame:
    """tables (of prefix_tables, or joined with other columns) with n_tokens: the count of each text's first `chars`
    code points (a column or a number). Nothing is encoded again."""
    last = F.size(F.filter("places", lambda x: x <= (F.lit(chars) if isinstance(chars, int) else F.col(chars))))
    return tables.withColumn("n_tokens", F.element_at("counts", last))


def within_budget(tables: DataFrame, budget: int) -> DataFrame:
    """tables with limit_chars: the first place from which on each longer prefix has more than `budget` tokens; null if
    the whole text is within it. Nothing is encoded again."""
    over = F.filter(F.arrays_zip("places", "counts"), lambda x: x["counts"] <= budget)
    following = F.get("places", F.array_position("places", F.element_at(over, -1)["places"]).cast("int"))
    return tables.withColumn("limit_chars", following - 1)
