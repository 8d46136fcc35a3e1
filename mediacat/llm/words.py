"""Words of Arrow text columns as 64-bit hashes, computed with numpy over the columns' own bytes.

A word's hash is a polynomial over its bytes modulo 2**64 (a random value for each byte, an odd base), passed through a
mixer; prefix sums give the hashes of all words of a slice of documents at once, without a Python object for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: two rounds of multiply and shift."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        x = np.full(length, base, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return series(_BASE), series(_BASE_INVERSE)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def separators(codes: bytes) -> np.ndarray:
    """A table from bytes to bytes: these codes become 0, which ends a word, and A-Z become a-z."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[list(codes)] = 0
    to[0] = to[0] if 0 in codes else 255  # 0 is then an ordinary byte; 255 is none of UTF-8
    return to


#: The five white-space codes after a tab, and the space.
WHITE = separators(bytes([0x20, *range(0x09, 0x0E)]))


def text_column(column: pa.Array) -> pa.Array:
    """A column of strings as Arrow's plain string type, null as empty."""
    column = column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes: first and last row, their bytes, their offsets in these."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def find_words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, cut at documents, and the place of each document's first word, with the end behind."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


class HashPrefixes:
    """Running sums over bytes, from which the hash of any stretch of them follows."""

    def __init__(self, b: np.ndarray) -> None:
        power, self.inverse = _powers(1 << max(20, int(len(b)).bit_length()))
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_byte_values()[b] * power[: len(b)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] if len(starts) else np.zeros(0, np.uint64))


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of these stretches of bytes."""
    return HashPrefixes(b).hashes(starts, ends)


def hash_words(raw: np.ndarray, offsets: np.ndarray, to: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and for each document the place of its first word, with the end behind."""
    b = to[raw]
    starts, ends, bounds = find_words(b != 0, offsets)
    return hash_spans(b, starts, ends), bounds


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between successive bounds; 0 for empty stretches."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
