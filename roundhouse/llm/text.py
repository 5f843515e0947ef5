"""Vectorised word and byte arithmetic over Arrow text batches.

All functions work on the raw UTF-8 buffer of a slice of texts, so one numpy
call handles thousands of texts at once and no Python object is made per
word. A word is a maximal run of bytes other than space and 0x09-0x0D, i.e.
``[^\\x20\\x09-\\x0D]+`` (UTF-8 continuation bytes never fall in that range).
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, 5 mod 8: powers do not repeat early
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            out = np.ones(size, dtype=np.uint64)
            k = 1
            while k < size:  # doubling: out[k:2k] = out[:k] * b**k
                out[k:2 * k] = out[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            made.append(out)
        have = _powers[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def windows_hash(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93 | 1) -> np.ndarray:
    """64-bit polynomial hash of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if width <= 8:
        out = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            out += values[j:j + n] * np.uint64(pow(base, j, 1 << 64))
        return mix(out)
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def slices(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``max_bytes``.

    Bounds the memory of what is computed per byte; one longer text is a run of
    its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the index of each text's first word
    (one more entry than texts)."""
    inside = ~SEPARATOR[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begins[edge] = inside[edge]        # a text's first byte starts a word
    ends[edge - 1] = inside[edge - 1]  # a text's last byte ends one
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    up, down = powers(_BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """(hash of each word, first-word index per text, starts, ends)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offsets)
    return span_hash(buf, starts, ends), first, starts, ends


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)
