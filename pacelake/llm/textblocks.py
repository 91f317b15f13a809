"""Array views of text columns, for the operators of this subpackage.

A text column arrives in a task as an Arrow array whose bytes lie in one
buffer.  The helpers below work on that buffer with numpy, a few megabytes
at a time, so no Python object is made per word, shingle or byte.  Memory
follows the chunk (``CHUNK`` bytes, or one text where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64

#: Space, tab, line feed, vertical tab, form feed and carriage return part words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII other than letters and digits, for operators that compare texts without punctuation.
IS_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array of uint64."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A random-looking value for each byte; EXACT tells upper from lower case, FOLDED doesn't.
EXACT = mix(np.arange(1, 257, dtype=np.uint64))
FOLDED = EXACT[LOWER]

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(steps)
    return _powers[:n], _inverse[:n]


def prefix_sums(buf: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    """Sums of value * base**position up to each position: the hash of any span is a difference."""
    up, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values[buf] * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), the same wherever its bytes stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _GOLDEN)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], type=column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return bytes_, offsets


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), each of about ``limit`` bytes, always of whole texts."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes that don't part words) and the number of words before each text (one more than texts)."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~apart[buf]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(buf)]
    opens[cut] = inside[cut]
    start = np.flatnonzero(opens)
    closes = inside
    last = closes.copy()
    last[:-1] &= ~closes[1:]
    before = cut[cut > 0] - 1
    last[before] = closes[before]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray = FOLDED, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (A-Z taken as a-z) and the number of words before each text."""
    start, end, before = words(buf, offsets, apart)
    return span_hashes(prefix_sums(buf, values), start, end), before


def gram_hashes(word: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word grams that lie within one text, and the number of grams before each text."""
    counts = np.diff(before)
    made = np.maximum(counts - (n - 1), 0)
    starts = np.concatenate(([0], np.cumsum(made)))
    at = np.arange(starts[-1]) + np.repeat(before[:-1] - starts[:-1], made)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = h * _GOLDEN + word[at + k]
    return mix(h), starts
