"""Whole batches of texts as flat byte arrays: words, windows and their hashes in numpy.

Texts arrive in Arrow batches. A batch is cut into slices of a bounded number of
bytes (one very long text makes a slice of its own), and everything inside a slice
is computed on arrays over all its bytes or all its words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Powers that a worker keeps for the next slice.
KEPT_POWERS = SLICE_BYTES + (1 << 18)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~_SPACE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
LETTER_OR_DIGIT = np.ones(256, bool)
LETTER_OR_DIGIT[0x00:0x30] = False
LETTER_OR_DIGIT[0x3A:0x61] = False
LETTER_OR_DIGIT[0x7B:0x80] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any substrings of a sequence of 64-bit values, from one prefix sum.

    The hash of values[s:e] is a polynomial in an odd base modulo 2**64, shifted back to
    position zero by the inverse base, so equal runs hash alike wherever they stand.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, dtype=np.uint64)) << 3 & _MASK | 5
        self.back = pow(self.base, -1, 1 << 64)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _table(self, n: int, inverse: bool) -> np.ndarray:
        """The powers of the base, or of its inverse; only those for texts of usual size are kept."""
        known = self._inverse if inverse else self._powers
        if len(known) >= n:
            return known
        steps = np.full(max(n, KEPT_POWERS), self.back if inverse else self.base, np.uint64)
        steps[0] = 1
        np.cumprod(steps, out=steps)
        if n <= KEPT_POWERS:
            if inverse:
                self._inverse = steps
            else:
                self._powers = steps
        return steps

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._table(n, False)[:n], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (prefix[end] - prefix[start]) * self._table(len(prefix), True)[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """The hash of every run of `length` values, by its start."""
        n = len(prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (prefix[length:] - prefix[:n]) * self._table(len(prefix), True)[:n]
        return mix(raw + np.uint64(length * 0x9E3779B97F4A7C15 & _MASK))


BYTES = Rolling(11)
WORDS = Rolling(12)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts (one more at the end)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one piece have `limit` bytes at most, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a slice: byte ranges, the word index at which each text starts, hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.at = at
        mask = kind[self.data]
        before = np.zeros(len(mask) + 1, bool)
        before[1:] = mask
        before[at] = False
        self.start = np.flatnonzero(mask & ~before[:-1])
        after = np.zeros(len(mask) + 1, bool)
        after[:-1] = mask
        after[at] = False
        self.end = np.flatnonzero(mask & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def document(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        prefix = BYTES.prefix(BYTES.table[self.data])
        return BYTES.between(prefix, self.start, self.end)

    def room(self) -> np.ndarray:
        """How many words are left in the text from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any of the runs."""
    starts = np.asarray(starts, np.int64)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; no run passes a break."""
    before = np.zeros(len(mask) + 1, bool)
    before[1:] = mask
    before[breaks] = False
    after = np.zeros(len(mask) + 1, bool)
    after[:-1] = mask
    after[breaks] = False
    return np.flatnonzero(mask & ~before[:-1]), np.flatnonzero(mask & ~after[1:]) + 1


def per_text(mask_or_values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over each text, for values laid out word by word (or byte by byte)."""
    total = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def binary_column(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
