"""Vectorised scanning of UTF-8 text straight from Arrow buffers.

A *word* is a longest run of letters and digits (Unicode), in lower case. All functions work on a block of rows whose
bytes lie in one array; no Python string is made per row or per word. Blocks hold about ``BLOCK_BYTES`` bytes, so the
working memory does not depend on the size of a batch; a single longer text is one block of its own, scanned whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)

SKIP, SYMBOL, CONTINUED = 0, 1, 2


def _fold(code_point: int) -> int:
    """The symbol of a code point: its lower case if it is a letter or digit, else 0 (skipped)."""
    low = chr(code_point).lower()[0]
    return ord(low) if unicodedata.category(low)[0] == "L" or unicodedata.category(low) == "Nd" else 0


ASCII_FOLD = np.zeros(256, dtype=np.uint32)
ASCII_FOLD[:128] = [_fold(c) for c in range(128)]
ASCII_KIND = (ASCII_FOLD > 0).astype(np.uint8)
_FOLDED: dict[int, int] = {}


class Block(NamedTuple):
    """Rows ``first`` to ``first + len(offsets) - 1`` of a column; ``offsets`` are relative to ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """``hashes`` of all words of a block in order, ``counts`` of words by row, ``starts``/``ends`` in bytes of the block."""

    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def firsts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield Block(row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded symbol of each character at its first byte (0 where skipped), and the kind of each byte."""
    symbol, kind = ASCII_FOLD[data], ASCII_KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        head = data[lead].astype(np.uint32)
        length = np.where(head >= 0xF0, 4, np.where(head >= 0xE0, 3, 2))
        point = head & np.where(length == 4, 0x07, np.where(length == 3, 0x0F, 0x1F)).astype(np.uint32)
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        for k in (1, 2, 3):
            point = np.where(length > k, (point << 6) | (padded[lead + k] & 0x3F), point)
        seen, inverse = np.unique(point, return_inverse=True)
        for c in seen.tolist():
            if c not in _FOLDED:
                _FOLDED[c] = _fold(c) if c <= 0x10FFFF else 0
        folded = np.array([_FOLDED[c] for c in seen.tolist()], dtype=np.uint32)[inverse]
        symbol[lead] = folded
        kept = folded > 0
        kind[lead[kept]] = SYMBOL
        for k in (1, 2, 3):
            at = lead[kept & (length > k)] + k
            kind[at[at < len(data)]] = CONTINUED
    return symbol, kind


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(block: Block) -> Words:
    """Hash every word of a block (polynomial over its folded symbols, then mixed)."""
    data, offsets = block.data, block.offsets
    symbol, kind = symbols(data)
    inside = kind > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[row_starts] = inside[row_starts]
    at = np.flatnonzero(kind == SYMBOL)
    first = np.flatnonzero(opens[at])
    if not len(first):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), empty, empty)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    hashes = mixed(np.add.reduceat(symbol[at].astype(np.uint64) * powers(BASE, int(lengths.max()))[place], first))
    starts = at[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    row_ends = row_starts[row_starts > 0] - 1
    closes[row_ends] = inside[row_ends]
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(hashes, counts, starts, np.flatnonzero(closes) + 1)


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of ``k`` words within a row, and the index of the first word of each."""
    hashes = found.hashes
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= GRAM_BASE
        total += hashes[j : n + j]
    rows = found.rows
    valid = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mixed(total[valid]), valid
