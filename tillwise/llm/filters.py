"""Bloom filters of bounded size over 64-bit values, for tasks to leave out what can't match.

A filter only spares work: whatever it lets through is joined exactly afterwards. Its size follows
the number of values up to ``MOST_BITS``; beyond that it lets more through and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillwise.llm.tokens import mix

LEAST_BITS, MOST_BITS = 20, 27
#: Bytes of a filter in one row.
_PIECE = 1 << 17


class Filter:
    """Tells which values may be held. Eight places share a byte, in tasks as well."""

    def __init__(self, bits: int, packed: bytes):
        self.bits, self.packed = bits, packed

    def __reduce__(self):
        return Filter, (self.bits, self.packed)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.packed, np.uint8)
        held = np.ones(len(values), bool)
        for places in _places(values, self.bits):
            held &= table[places >> np.uint64(3)] & _bit(places) != 0
        return held


def _bit(places: np.ndarray) -> np.ndarray:
    return np.uint8(128) >> (places & np.uint64(7)).astype(np.uint8)


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.ascontiguousarray(values).view(np.uint64) + np.uint64(0x1CE4E5B9))
    return h >> np.uint64(64 - bits), (h >> np.uint64(4)) & np.uint64((1 << bits) - 1)


def filter_of(values: DataFrame, name: str, least: int = LEAST_BITS) -> Filter:
    """The filter that holds a long column, of 2^``least`` places or more; nulls are left out."""
    held = values.where(f"{name} IS NOT NULL").select(name)
    bits = min(MOST_BITS, max(least, (16 * max(1, held.count())).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for places in _places(batch[name].to_numpy(), bits):
                np.bitwise_or.at(table, places >> np.uint64(3), _bit(places))
        for at in range(0, len(table), _PIECE):
            piece = table[at : at + _PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([piece.tobytes()])], ["at", "bits"])

    packed = np.zeros((1 << bits) // 8, np.uint8)
    # A few tasks, as each sends as much as the filter is large, one after the other.
    for row in held.coalesce(6).mapInArrow(part, "at long, bits binary").toLocalIterator():
        piece = np.frombuffer(row["bits"], np.uint8)
        packed[row["at"] : row["at"] + len(piece)] |= piece
    return Filter(bits, packed.tobytes())
