"""Exact, cached encoding with the public word-level BPE (tokenizers, word_bpe_49k.json).

The vocabulary drops white space and never merges over it, so a text's ids are those of its white-space-separated
chunks, one after the other. Chunks repeat, so their ids are cached, in a bounded cache of two generations. Chunks
of plain letters and punctuation are cut by rule and go to the library's BPE model; all other chunks (special
strings, marks, scripts beyond Latin) go through the library's whole encoder.
"""

from __future__ import annotations

import array
import re

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's split pattern, restricted to ASCII text.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: ASCII punctuation; the apostrophe is left out because contractions start with it.
_PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
_CACHE = 300_000
_KEY = 64


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations:
    """A dict that forgets: at `most` entries the young generation becomes the old one, and the old one goes."""

    def __init__(self, most: int = _CACHE):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordBpe:
    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        self.bytes_to_alphabet = _byte_level()
        self.chunks = Generations()
        self.pieces = Generations(_CACHE // 2)

    def pieces_of(self, chunk: str) -> list[str] | None:
        """The pre-tokens of a chunk without white space, or None if only the library can tell."""
        if "<|" in chunk:
            return None
        low = chunk.lower()
        core = low.strip(_PUNCTUATION)
        if not core:
            return [low]
        if core.isalpha() and (low.isascii() or max(low) < "ɐ"):
            at = low.index(core)
            return [x for x in (low[:at], core, low[at + len(core) :]) if x]
        return _ASCII_PIECES.findall(low) if low.isascii() else None

    def alphabet(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes_to_alphabet)

    def piece_ids(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = array.array("I", [t.id for t in self.model.tokenize(self.alphabet(piece))]).tobytes()
            if len(piece) <= _KEY:
                self.pieces.put(piece, found)
        return found

    def library_ids(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk_ids(self, chunk: bytes) -> bytes:
        """The ids of a chunk without ASCII white space, as native 32-bit integers."""
        text = chunk.decode("utf-8", "replace")
        pieces = self.pieces_of(text)
        found = self.library_ids(text) if pieces is None else b"".join(map(self.piece_ids, pieces))
        if len(chunk) <= _KEY:
            self.chunks.put(chunk, found)
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text, as native 32-bit integers."""
        chunks = text.split()
        out = list(map(self.chunks.young.get, chunks))
        if None in out:
            get = self.chunks.get
            for i, x in enumerate(out):
                if x is None:
                    found = get(chunks[i])
                    out[i] = self.chunk_ids(chunks[i]) if found is None else found
        return b"".join(out)


_own: dict[str | None, WordBpe] = {}


def word_bpe(path: str | None = None) -> WordBpe:
    """This worker's encoder; it lives as long as the worker, and so does its cache."""
    if path not in _own:
        _own[path] = WordBpe(path)
    return _own[path]
