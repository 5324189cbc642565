"""Vectorised word scanning over the UTF-8 buffers of Arrow string columns.

Nothing here builds a Python string: a column is a flat byte array plus
offsets, words are found from a 256-entry byte table, and word hashes come
from one polynomial prefix sum (modulo 2**64) whose differences, rescaled by
the inverse power, depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer document is handled alone.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1024)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of a byte array; length + 1 entries."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(len(data))[0], out=out[1:])
    return out


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes each, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def table(keep) -> np.ndarray:
    """Byte table: 0 for separators, else the byte with A-Z lowered."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[b for b in range(256) if not keep(b)]] = 0
    return out


#: Words are runs without space, tab, newline, vertical tab, form feed, return.
SPACED = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# NUL is a word byte there; any non-zero stand-in that no text holds will do.
SPACED[0] = 0xFF
#: Words are runs of ASCII letters and digits and of all non-ASCII bytes.
LETTERS = table(lambda b: b >= 0x80 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)


def spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Lowered bytes, and start, end and document of every word."""
    low = classes[data]
    inside = low != 0
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    before[at] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    after[at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, dependent on its lowered bytes alone."""
    p = prefix(low)
    return mix((p[ends] - p[starts]) * powers(len(low) + 1)[1][starts])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries of h."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j : j + n]
    return mix(out)


def word_hash(word: str, classes: np.ndarray) -> int:
    """hashes() of a single word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    low = classes[raw]
    return int(hashes(low, np.array([0]), np.array([len(low)]))[0])
