"""64-bit hashes of all words of a text at once, from its bytes.

A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums over a block of the text, so that
no word is touched one by one; its length is mixed in, and the bits are mixed last. Blocks end between words, so that
memory beyond the hashes themselves is bounded, however long a text is; a longer word is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_LENGTH, _MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S1, _S2 = np.uint64(32), np.uint64(29)
WHITE_SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 17


def separators(chars: bytes) -> np.ndarray:
    """A table that tells for each byte whether it separates words."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


class _Powers:
    """Powers of the base and of its inverse, as far as the longest text needed them."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << max(16, n.bit_length())
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


_powers = _Powers()


def blocks_of(text: bytes, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The bytes of a text in blocks that end between words, each with its place."""
    a, at = np.frombuffer(text, np.uint8), 0
    while at < len(a):
        end = min(len(a), at + BLOCK_BYTES)
        while end < len(a):  # on to the end of a word
            stops = np.flatnonzero(table[a[end : end + BLOCK_BYTES]])
            if len(stops):
                end += int(stops[0])
                break
            end = min(len(a), end + BLOCK_BYTES)
        yield at, a[at:end]
        at = end


def word_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    out = [_Block(a, table).words()[1] for _, a in blocks_of(text, table)]
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint64), *out])


def part_hashes(text: bytes, table: np.ndarray, firsts: tuple[int, ...], lasts: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the words of a text; of the first n bytes of those that are longer, for each n of firsts;
    and of the last n bytes of those that are longer, for each n of lasts."""
    out: list[list] = [[] for _ in range(1 + len(firsts) + len(lasts))]
    for at, a in blocks_of(text, table):
        b = _Block(a, table)
        for have, (starts, hashes) in zip(out, (b.words(), *map(b.first, firsts), *map(b.last, lasts))):
            have.append((starts + at, hashes))
    return [(np.concatenate([np.zeros(0, np.int64), *(s for s, _ in x)]), np.concatenate([np.zeros(0, np.uint64), *(h for _, h in x)])) for x in out]


def distinct(a: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers of an array; by sorting, which is several times as fast here as a hash table."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


class _Block:
    """Words of a block, with running sums that give the hash of any of their parts."""

    def __init__(self, a: np.ndarray, table: np.ndarray):
        n = len(a)
        _powers.upto(n)
        inside = np.empty(n + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~table[a]
        edge = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((a + np.uint64(1)) * _powers.up[:n], out=self.sums[1:])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes(self.starts, self.ends)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        s = self.starts[self.ends - self.starts > n]
        return self.hashes(s, s + n)

    def last(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        e = self.ends[self.ends - self.starts > n]
        return self.hashes(e - n, e)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (self.sums[ends] - self.sums[starts]) * _powers.down[starts]
        h += (ends - starts).astype(np.uint64) * _LENGTH
        h ^= h >> _S1
        h *= _MIX
        h ^= h >> _S2
        return starts, h
