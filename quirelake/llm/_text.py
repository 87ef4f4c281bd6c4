"""Vectorised tokens over Arrow string buffers.

A word is a maximal run of ASCII letters, digits and underscores and of
non-ASCII characters, after lower-casing. Words are known by a 64-bit
polynomial hash, computed for all words of a chunk by prefix sums, so no Python
string is ever made. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARK = ~WORD & ~SPACE
#: The same words as a regular expression over lower-cased text (RE2 and Java).
WORD_PATTERN = r"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+"

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << int(n).bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` values (modulo 2**64)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


@dataclass
class Tokens:
    """Words of a run of documents.

    hashes, starts and ends (bytes of the chunk) have an entry a word;
    documents i has words bounds[i] to bounds[i + 1] and bytes offsets[i] to
    offsets[i + 1]; first is its row in the column.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))


def large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``size`` bytes, at least one row each."""
    _, offsets = raw(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of a kind, within documents."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def tokens_of(first: int, piece: pa.Array) -> Tokens:
    data, offsets = raw(pc.utf8_lower(piece))
    starts, ends = runs(data, offsets, WORD)
    return Tokens(first, data, offsets, hashed(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def tokenised(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Tokens]:
    """The words of a column of texts, a chunk of rows at a time."""
    for first, piece in slices(large(column), size):
        yield tokens_of(first, piece)


def word_hashes(text: str | None) -> np.ndarray:
    """The word hashes of one text."""
    return tokens_of(0, large(pa.array([text], pa.string()))).hashes
