"""Vectorised word and shingle hashes of UTF-8 text held in Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 18  # bytes hashed at once; bounds the memory a long text needs
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
FOLDED, CASED = _LOWER, _BYTE  # values of bytes with A-Z lower-cased, and as they are
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = max(_BLOCK * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, U(_BASE)), np.full(size, U(inverse))
        up[0] = down[0] = 1
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row starts in them; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; a longer row stands alone."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end
        row = end


def word_hashes(data: np.ndarray, at: np.ndarray, of_byte: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each row, A-Z lower-cased unless CASED is given, and where each row's words start."""
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at[at < len(data)]] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = True
        after[:-1] = space[1:]
        after |= first[1:]
    ends = np.flatnonzero(~space & after) + 1
    out = np.empty(len(starts), U)
    w = 0
    while w < len(starts):
        z = max(w + 1, int(np.searchsorted(ends, starts[w] + _BLOCK, "right")))
        lo, hi = int(starts[w]), int(ends[z - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(of_byte[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[w:z] - lo, ends[w:z] - lo
        out[w:z] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        w = z
    return out, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its word shingles.

    A row with fewer words than width has its whole sequence as one; a row without words has none.
    """
    words, row = word_hashes(data, at)
    rolled = np.zeros(0, U)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * U(_BASE) + words[k : len(words) - width + 1 + k]
        rolled = mix(rolled)
    for lo, hi in zip(row[:-1].tolist(), row[1:].tolist()):
        if hi - lo >= width:
            x = np.sort(rolled[lo : hi - width + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            yield x[keep]
        elif hi > lo:
            x = words[lo:lo + 1].copy()
            for k in range(lo + 1, hi):
                x = x * U(_BASE) + words[k]
            yield mix(x + U(hi - lo))
        else:
            yield np.zeros(0, U)
