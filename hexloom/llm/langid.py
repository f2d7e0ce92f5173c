"""Language identification by segmentation-marginalised unigrams (operator 10).

Each language has a probability for every piece of a fixed public vocabulary (sentencepiece, piece_bpe_32k.model).
The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm; that of a
text is the product over its words. Piece probabilities are fitted by expectation-maximisation (forward-backward)
on the counts of all words of a bounded sample of labelled texts per language. Words are cached with their scores.

Words are runs of letters (category L), of any length; those of up to BATCH_LETTERS letters go through the forward
algorithm many at a time, longer ones one by one in logarithms.

Defined results: null texts and texts without a letter are `und`, with score 0; without any labelled text all
others are `und`, too; ties go to the language first in order; documents without an id are not held out, and learned
from; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, map_arrow, text_bytes
from hexloom.llm.wordbpe import Generations

VOCABULARY = "piece_bpe_32k.model"
#: Labelled texts per language that a model is fitted to.
SAMPLE_TEXTS = 400
ROUNDS = 3
#: Words of up to so many letters are scored many at a time, and cached.
BATCH_LETTERS = 64
#: Forward sums are multiplied by this for each letter, so that those of a long word stay in range.
_LIFT = 3000.0
_RUNS = re.compile(r"[^\W\d_]+")
_START = "▁"
#: A match of the automaton is one number: the piece, and over it the length.
_BITS = 24
_PIECE = (1 << _BITS) - 1


def pieces(path: str | None = None) -> dict[str, int]:
    """The vocabulary's pieces of letters, numbered; the last number stands for any letter that is no piece."""
    p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = [x for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)) and (x := p.id_to_piece(i)).removeprefix(_START).isalpha()]
    return {x: i for i, x in enumerate(dict.fromkeys(found))}


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text in lower case; numerals that are no digits (½, Ⅷ) part them, as all else does."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


class Pieces:
    """The vocabulary with an automaton that finds all pieces in a word."""

    def __init__(self, path: str | None = None):
        self.number = pieces(path)
        self.finder = ahocorasick.Automaton()
        for x, k in self.number.items():
            self.finder.add_word(x, len(x) << _BITS | k)
        self.finder.make_automaton()

    def edges(self, word: str) -> tuple[int, list[tuple[int, int, int]]]:
        """The length of a word (with its start mark) and the (start, end, piece) in it, by their ends."""
        text = _START + word
        out, single = [], [False] * len(text)
        for last, v in self.finder.iter(text):
            n = v >> _BITS
            out.append((last + 1 - n, last + 1, v & _PIECE))
            if n == 1:
                single[last] = True
        if not all(single):
            out += [(i, i + 1, len(self.number)) for i, x in enumerate(single) if not x]
            out.sort(key=lambda e: e[1])
        return len(text), out


def forward(length: int, edges: list[tuple[int, int, int]], q: list[float]) -> list[float]:
    """The probabilities of all prefixes, each summed over its segmentations."""
    a = [1.0] + [0.0] * length
    for s, e, k in edges:
        a[e] += a[s] * q[k]
    return a


def log_forward(length: int, edges: list[tuple[int, int, int]], q: list[float]) -> list[float]:
    """forward() in logarithms, for words of any length; q: log probabilities."""
    a = [0.0] + [-math.inf] * length
    for s, e, k in edges:
        x, y = a[s] + q[k], a[e]
        a[e] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if y > -math.inf else x
    return a


class Lattice:
    """The segmentations of many words of up to BATCH_LETTERS letters, as arrays."""

    def __init__(self, words: list[str], vocabulary: Pieces):
        matches = [list(vocabulary.finder.iter(_START + w)) for w in words]
        counts = list(map(len, matches))
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(matches)), np.int64, 2 * sum(counts)).reshape(-1, 2)
        self.lengths = np.asarray([len(w) + 1 for w in words])
        row, end, size, piece = np.repeat(np.arange(len(words)), counts), flat[:, 0] + 1, flat[:, 1] >> _BITS, flat[:, 1] & _PIECE
        self.wide = wide = int(self.lengths.max()) + 1
        # letters that are no piece of their own
        bare = np.arange(1, wide + 1)[None, : wide - 1] <= self.lengths[:, None]
        one = size == 1
        bare[row[one], end[one] - 1] = False
        more_row, more_end = np.nonzero(bare)
        row, end = np.concatenate([row, more_row]), np.concatenate([end, more_end + 1])
        size = np.concatenate([size, np.ones(len(more_row), np.int64)])
        piece = np.concatenate([piece, np.full(len(more_row), len(vocabulary.number))])
        order = np.argsort(end, kind="stable")
        row, end, size, self.piece = row[order], end[order], size[order], piece[order]
        self.to, self.of, self.lift = row * wide + end, row * wide + end - size, _LIFT**size
        self.steps = np.searchsorted(end, np.arange(1, wide + 1))
        self.last = np.arange(len(words)) * wide + self.lengths

    def forward(self, p: np.ndarray) -> np.ndarray:
        """The lifted forward sums, by word and end; p: pieces x languages."""
        a = np.zeros((len(self.lengths) * self.wide, p.shape[1]))
        a[:: self.wide] = 1.0
        for lo, hi in zip(self.steps, self.steps[1:]):
            if hi > lo:
                np.add.at(a, self.to[lo:hi], a[self.of[lo:hi]] * p[self.piece[lo:hi]] * self.lift[lo:hi, None])
        return a

    def logs(self, p: np.ndarray) -> np.ndarray:
        """The log probability of each word in each language."""
        return np.log(self.forward(p)[self.last]) - (self.lengths * math.log(_LIFT))[:, None]

    def soft_counts(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, of which there are n each; for one language."""
        a, b = self.forward(p[:, None])[:, 0], np.zeros(len(self.lengths) * self.wide)
        b[self.last] = 1.0
        weight, soft = p[self.piece] * self.lift, np.zeros(len(p))
        scale = (n / a[self.last])[self.to // self.wide]
        for lo, hi in zip(self.steps[-2::-1], self.steps[:0:-1]):
            x = b[self.to[lo:hi]] * weight[lo:hi]
            np.add.at(b, self.of[lo:hi], x)
            soft += np.bincount(self.piece[lo:hi], a[self.of[lo:hi]] * x * scale[lo:hi], len(p))
        return soft


def _long_soft_counts(word: str, n: int, vocabulary: Pieces, p: np.ndarray) -> np.ndarray:
    """soft_counts() of one long word, in logarithms."""
    length, edges = vocabulary.edges(word)
    q, soft = np.log(p).tolist(), np.zeros(len(p))
    a = log_forward(length, edges, q)
    b = log_forward(length, [(length - e, length - s, k) for s, e, k in sorted(edges, key=lambda x: -x[0])], q)
    for s, e, k in edges:
        soft[k] += n * math.exp(a[s] + q[k] + b[length - e] - a[length])
    return soft


def fit_pieces(words: dict[str, int], vocabulary: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language, by expectation-maximisation over all segmentations of its words."""
    n = len(vocabulary.number) + 1
    short = sorted(w for w in words if len(w) <= BATCH_LETTERS)
    parts = [(Lattice(short[i : i + 8192], vocabulary), np.asarray([words[w] for w in short[i : i + 8192]], float)) for i in range(0, len(short), 8192)]
    long = {w: c for w, c in words.items() if len(w) > BATCH_LETTERS}
    p = np.full(n, 1.0 / n)
    for _ in range(rounds):
        soft = sum((x.soft_counts(p, c) for x, c in parts), np.zeros(n)) + sum((_long_soft_counts(w, c, vocabulary, p) for w, c in sorted(long.items())), np.zeros(n))
        p = soft + 0.01
        p /= p.sum()
    return p


class Model:
    def __init__(self, languages: list[str], p: np.ndarray, vocabulary: Pieces):
        self.languages, self.vocabulary = languages, vocabulary
        self.p = np.ascontiguousarray(p.T)  # pieces x languages
        self.words, self.chunks, self.now = Generations(200_000), Generations(200_000), {}

    def learn(self, words: list[str]) -> None:
        """Finds the log probabilities of new words under each language, all words at once; caches the short ones."""
        short = [w for w in words if len(w) <= BATCH_LETTERS]
        if short:
            for w, x in zip(short, Lattice(short, self.vocabulary).logs(self.p).tolist()):
                self.now[w] = x
                self.words.put(w, x)
        for w in words:
            if len(w) > BATCH_LETTERS:
                length, edges = self.vocabulary.edges(w)
                self.now[w] = [log_forward(length, edges, np.log(q).tolist())[length] for q in self.p.T]

    def texts(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """The language and its posterior probability, for each text."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        counts = [Counter(t.split()) for t in texts]
        fresh: dict[bytes, list[str]] = {}
        known: dict[bytes, object] = {}
        for c in counts:
            for chunk in c:
                if chunk not in known and chunk not in fresh:
                    found = self.chunks.get(chunk)
                    if found is None:
                        fresh[chunk] = letter_runs(chunk.decode("utf-8", "replace"))
                    else:
                        known[chunk] = found
        self.now = {}
        new = set()
        for w in {w for words in fresh.values() for w in words}:
            found = self.words.get(w)
            if found is None:
                new.add(w)
            else:
                self.now[w] = found
        new = sorted(new)
        for i in range(0, len(new), 4096):
            self.learn(new[i : i + 4096])
        for chunk, words in fresh.items():
            known[chunk] = found = self.now[words[0]] if len(words) == 1 else [sum(x) for x in zip(*(self.now[w] for w in words))] if words else 0
            if len(chunk) <= BATCH_LETTERS:
                self.chunks.put(chunk, found)
        out = []
        for c in counts:
            rows = [(known[chunk], n) for chunk, n in c.items() if known[chunk]]
            if not rows:
                out.append(("und", 0.0))
                continue
            s = np.asarray([n for _, n in rows], float) @ np.asarray([x for x, _ in rows])
            k = int(np.argmax(s))
            out.append((self.languages[k], float(1 / np.exp(s - s[k]).sum())))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.update((lang, w) for w in letter_runs(text.decode("utf-8", "replace")))
    yield batch(["lang", "word", "n"], [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())], [pa.string(), pa.string(), pa.int64()])


_own: dict[bytes, Model] = {}


def _predict(batches: Iterator[pa.RecordBatch], languages: list[str], p: bytes, path: str | None) -> Iterator[pa.RecordBatch]:
    key = hashlib.sha256(repr((languages, path)).encode() + p).digest()
    if key not in _own:
        _own.clear()
        _own[key] = Model(languages, np.frombuffer(p).reshape(len(languages), -1) if languages else np.zeros((0, 1)), Pieces(path))
    model = _own[key]
    collects = gc.isenabled()
    gc.disable()  # millions of small lists live in the caches and none is part of a cycle
    try:
        for b in batches:
            found = model.texts(b.column("text").to_pylist())
            yield batch(["doc_id", "held_out", "lang_pred", "score"], [b.column("doc_id"), b.column("held_out"), [x for x, _ in found], [y for _, y in found]], [pa.int64(), pa.bool_(), pa.string(), pa.float64()])
    finally:
        if collects:
            gc.enable()


def identify(docs: DataFrame, vocabulary_path: str | None = None, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; learned from the documents that are not held out."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_bytes().alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = df.filter("not held_out and lang is not null")
    # a bounded sample, by hashes of the ids; there are a few languages
    sizes = dict(learn.groupBy("lang").count().collect())
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_texts / n)).otherwise(share)
    chosen = learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 32)) < share * float(1 << 32)).select("lang", "text")
    counted = map_arrow(chosen, _word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, list] = {x: [] for x in sorted(sizes)}
    for lang, word, n in counted.collect():  # the words of sample_texts texts per language
        words[lang].append((n, word))
    vocabulary = Pieces(vocabulary_path)
    languages = [x for x in words if words[x]]
    p = [fit_pieces({w: n for n, w in words[x]}, vocabulary) for x in languages]
    p = np.asarray(p) if p else np.zeros((0, 1))
    return map_arrow(df.select("doc_id", "held_out", "text"), partial(_predict, languages=languages, p=p.tobytes(), path=vocabulary_path), "doc_id long, held_out boolean, lang_pred string, score double")
