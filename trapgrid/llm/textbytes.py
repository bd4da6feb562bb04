"""Text columns as one byte buffer per Arrow batch, with words and rolling hashes by numpy.

All functions work on the UTF-8 bytes of many texts at once. Nothing crosses from one text to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random number for each byte value; fixed, so that every task hashes alike.
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes; a longer text is a run of its own."""
    size = batch.num_rows
    if not size:
        return
    _, at = flat(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < size:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), size)
        yield batch.slice(first, last - first)
        first = last


class Rolling:
    """Hashes of any stretch of a byte buffer, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        base, inverse = _BASE, _BASE_INVERSE
        values = _BYTE_VALUES if not salt else mix(_BYTE_VALUES + np.uint64(salt)) | np.uint64(1)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        self._back = np.full(n + 1, inverse, np.uint64)
        self._back[0] = 1
        self._back = np.cumprod(self._back)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers[:n], out=self._sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), start and end as index arrays."""
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Hashes of the stretches of `length` at each place where one fits."""
        got = self._sums[length:] - self._sums[:-length]
        return mix(got * self._back[: len(got)] + np.uint64(length))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets): words of text i are the entries between word offsets i and i + 1.

    A word is a longest run of bytes that are not marked in `separator`.
    """
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[filled] = inside[filled]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finishes[ends] = inside[ends]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)
