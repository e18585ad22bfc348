"""Words and word n-grams of whole Arrow string columns, as numpy arrays.

The functions here run inside tasks. A batch is cut into slices of about 256 KB so that working
arrays stay small: they take some 40 bytes for each byte of a slice, in each task's Python process.
A text is never cut, so memory follows the longest text of a slice.
Words are runs of bytes that are not separators. All separators used here are ASCII, so runs
of bytes are runs of characters. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Odd 64-bit factors, one for each place of a word in an n-gram, derived from a fixed seed.
_PLACES = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) * 2 + 1
_BYTE_VALUES = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)

WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: np.uint64) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_BASE), series(_BASE_INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse; one table serves all slices of a task."""
    rounded = max(2 * SLICE_BYTES, 1 << (size - 1).bit_length())
    return _powers(rounded)


@dataclass
class Words:
    """Words of some texts: byte places, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        up, down = powers(len(self.data) + 1)
        summed = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * up[: len(self.data)], out=summed[1:])
        value = (summed[self.end] - summed[self.start]) * down[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))

    def text(self, i: int, j: int, sep: bytes = b" ") -> bytes:
        """The words from i to before j joined."""
        raw = self.data.tobytes() if i == 0 and j == len(self.start) else None
        if raw is None:
            low = int(self.start[i]) if j > i else 0
            raw = self.data[low : int(self.end[j - 1]) if j > i else 0].tobytes()
        else:
            low = 0
        return sep.join(raw[a - low : b - low] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about SLICE_BYTES each, of one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    i = 0
    while i < len(texts):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + SLICE_BYTES, side="right")))
        yield i, j
        i = j


def words(texts: pa.Array, lower: bool, separators: bytes = WHITE) -> Words:
    """The words of the texts; ``lower`` turns A-Z into a-z and nothing else."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    _, places, held = filled.buffers()
    at = np.frombuffer(places, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    low = at[0] if len(at) else 0
    data = np.frombuffer(held, np.uint8)[low : at[-1]] if held else np.zeros(0, np.uint8)
    at = at - low
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    in_word = np.ones(256, bool)
    in_word[list(separators)] = False
    inside = in_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]  # a text's words end with it
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive words, over text borders too (see ``gram_starts``)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, np.uint64((n * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) % (1 << 64)))
    for k in range(n):
        out += hashes[k : k + count] * _PLACES[k + (32 if salt else 0)]
    return mix(out)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that lie in one text, and that text's number."""
    per = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return first[:-1][doc] + within, doc


def as_signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column: ``counts`` values for each row."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
