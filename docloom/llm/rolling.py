"""Bucket identifiers of all places of many byte strings at once, and their anchors.

The bucket of a place is named by a hash of its ``q``-gram: a polynomial modulo 2**64 in random
values of the bytes, read off prefix sums. Refinement renames all places at once: the bucket of twice the
length is the pair of a place's identifier and the identifier at the later offset, which the
refinement before has just renewed. So identifiers of 1, 2, 4, ... q-grams come from one another, and no text
is hashed again. Names are equal on all machines, which ranks in sorted order would need a shuffle for.

Anchors: every window of ``length`` bytes picks, of the ``q``-grams in it, the one with the
smallest mixed hash, the leftmost of equal ones. What a window picks depends on its bytes
alone, so equal windows pick equal q-grams at equal offsets. Neighbouring windows mostly
pick the same one: about two anchors stand for ``length - q + 1`` windows.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

BLOCK = 1 << 20  # bytes hashed at once; positions in a block fit into the low bits of a key
_LOW = np.uint64(BLOCK - 1)
_BASE = 0x5851F42D4C957F2D
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base, powers of its inverse."""
    values = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def powers(base: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, base, np.uint64)]))

    return values, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Buckets:
    """Bucket identifiers of the places of at most ``BLOCK`` bytes: ``level(j)[i]`` names the ``q << j`` bytes from i on."""

    def __init__(self, data: np.ndarray, q: int) -> None:
        values, powers, inverse = _tables()
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * powers[: len(data)])])
        self.q, self.levels = q, [mixed((sums[q:] - sums[:-q]) * inverse[: max(len(data) - q + 1, 0)])]

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            known, later = self.levels[-1], self.q << (len(self.levels) - 1)
            many = max(len(known) - later, 0)
            self.levels.append(mixed(known[:many] * _PAIR + known[later : later + many]))
        return self.levels[j]

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of data[start:end], at least ``q`` bytes each: the identifier at the start and the one that ends at the end."""
        size = end - start
        out = np.zeros(len(start), np.uint64)
        level = np.zeros(len(start), np.int64)
        while (more := size >= self.q << (level + 1)).any():
            level[more] += 1
        for j in np.unique(level):
            at = np.flatnonzero(level == j)
            found = self.level(int(j))
            out[at] = mixed(found[start[at]] * _PAIR + found[end[at] - (self.q << int(j))] + size[at].astype(np.uint64))
        return out


class Piece(NamedTuple):
    """Bytes of a text from ``base`` on; its windows that start at ``first`` up to before ``stop`` are this piece's own."""

    row: int
    base: int
    data: bytes
    first: int
    stop: int


def pieces(row: int, data: bytes, length: int) -> list[Piece]:
    """A text as pieces that fit into a block and reach ``2 * length`` bytes beyond their own windows on both sides."""
    windows, step, margin = len(data) - length + 1, BLOCK // 2, 2 * length
    out = []
    for first in range(0, max(windows, 0), step):
        stop = min(first + step, windows)
        base = max(0, first - margin)
        out.append(Piece(row, base, data[base : stop + length + margin], first - base, stop - base))
    return out


def blocks(texts: list[bytes], length: int):
    """Lists of pieces that together fit into a block."""
    block, size = [], 0
    for row, data in enumerate(texts):
        for piece in pieces(row, data, length):
            if size + len(piece.data) > BLOCK:
                yield block
                block, size = [], 0
            block.append(piece)
            size += len(piece.data)
    if block:
        yield block


class Anchors(NamedTuple):
    """Arrays by anchor: row, position in the text, identifiers of its q-gram and of its surroundings, first and last window (as
    distances back from the position)."""

    row: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    around: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(block: list[Piece], length: int, q: int) -> Anchors:
    data = np.frombuffer(b"".join(p.data for p in block), np.uint8)
    size = np.fromiter((len(p.data) for p in block), np.int64, len(block))
    begin = np.cumsum(size) - size
    buckets, wide = Buckets(data, q), length - q + 1
    grams = buckets.level(0)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)

    # The least key of each run of ``wide`` grams, by prefix and suffix minima of blocks of that width.
    pad = -len(key) % wide
    rows = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - length + 1
    least = np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count])

    change = np.zeros(count + 1, np.int8)
    np.add.at(change, begin + [p.first for p in block], 1)
    np.add.at(change, begin + [p.stop for p in block], -1)
    window = np.flatnonzero(np.cumsum(change)[:count])
    chosen = (least[window] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    at = chosen[new]
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    of = np.searchsorted(begin, at, "right") - 1
    low = np.maximum(at - (wide - 1), begin[of])
    high = np.minimum(at + length, (begin + size)[of])
    around = mixed(buckets.names(low, high) ^ ((at - low) * 1024 + (high - low)).astype(np.uint64))
    base = np.fromiter((p.base for p in block), np.int64, len(block)) - begin
    row = np.fromiter((p.row for p in block), np.int64, len(block))
    return Anchors(row[of], at + base[of], grams[at], around, at - first, at - last)


def all_anchors(texts: list[bytes], length: int, q: int):
    """Anchors of all texts, in batches. Where a long text's pieces meet, an anchor that both picked becomes one."""
    held = None
    for block in blocks(texts, length):
        found = anchors(block, length, q)
        if held is not None:
            found = Anchors(*(np.concatenate(x) for x in zip(held, found, strict=True)))
        twice = np.flatnonzero((np.diff(found.row) == 0) & (np.diff(found.at) == 0))
        found.last[twice] = found.last[twice + 1]
        found = Anchors(*(np.delete(x, twice + 1) for x in found))
        held = Anchors(*(x[-1:] for x in found))
        yield Anchors(*(x[:-1] for x in found))
    if held is not None:
        yield held
