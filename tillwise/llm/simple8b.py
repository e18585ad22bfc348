"""Simple-8b: whole numbers packed into 64-bit words, each word as many as fit.

The four highest bits of a word are its selector, which says how many numbers of how many bits the
other 60 hold, the first in the lowest bits. Selector 1 stands for 120 zeros. Selector 0 is the escape
for a number of more than 60 bits: the word holds the place of that number among the verbatim words
at the end of its block.

Numbers are coded in blocks of ``BLOCK``. A coded piece, little-endian throughout, is

    b"S8B1", block size (uint32), how many numbers (uint64), how many blocks (uint64)
    offsets (uint64 for each block and one more): first word of each block, counted from the words' start
    verbatim (uint32 for each block): how many words at the block's end are verbatim numbers
    words (uint64)

so any block can be decoded alone. Coding and decoding work on all blocks of a piece at once: the widest
selector at each place comes from sliding maxima of the bit lengths, the blocks are then walked side by
side, and words are packed and unpacked selector by selector.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
MAGIC = b"S8B1"
#: Numbers and bits of each selector; fixed values of the code.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
_HEAD = struct.Struct("<4sIQQ")
_LOW = np.uint64((1 << 60) - 1)
_TOP = np.uint64(60)


#: Bit lengths of the numbers of 16 bits.
_LENGTHS = np.searchsorted(1 << np.arange(17), np.arange(1 << 16), side="right").astype(np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFFFF)
    out = _LENGTHS[ids & low]
    for shift in (16, 32, 48):
        large = np.nonzero(ids >> np.uint64(shift))
        if not len(large[0]):
            break
        part = _LENGTHS[(ids[large] >> np.uint64(shift)) & low]
        out[large] = np.where(part > 0, part + shift, out[large])
    return out


def _widest(bits: np.ndarray) -> np.ndarray:
    """The selector to use at each place of each block; places past a block's end count as zeros."""
    widest = {1: bits}

    def joined(a: int, b: int) -> None:
        """The maximum over a + b places, from those over a and b."""
        wide, rest = widest[a], widest[b]
        out = wide.copy()
        np.maximum(out[:, :-a], rest[:, a:], out=out[:, :-a])
        widest[a + b] = out

    steps = "1+1 2+1 2+2 4+1 4+2 4+3 4+4 8+2 8+4 8+7 12+8 15+15 30+30 60+60"
    for step in steps.split():
        joined(*map(int, step.split("+")))
    selector = np.full(bits.shape, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):  # from few numbers to many
        selector[widest[int(COUNTS[s])] <= BITS[s]] = s
    return selector


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint64)
    n, n_blocks = len(ids), -(-len(ids) // block)
    # One row for each block, with zeros behind its end.
    table = np.zeros((n_blocks, block + int(COUNTS.max())), np.uint64)
    padded = np.zeros(n_blocks * block, np.uint64)
    padded[:n] = ids
    table[:, :block] = padded.reshape(n_blocks, block)
    selector = _widest(_bit_lengths(table))
    held = np.full(n_blocks, block)
    if n_blocks:
        held[-1] = n - (n_blocks - 1) * block
    at, walking = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    rows, places, picks = [], [], []
    while len(walking):
        here = at[walking]
        chosen = selector[walking, here]
        rows.append(walking)
        places.append(here)
        picks.append(chosen)
        at[walking] = here + COUNTS[chosen]
        walking = walking[at[walking] < held[walking]]
    if n_blocks == 0:
        return _HEAD.pack(MAGIC, block, 0, 0) + np.zeros(1, "<u8").tobytes()
    row, place, pick = np.concatenate(rows), np.concatenate(places), np.concatenate(picks)
    order = np.argsort(row, kind="stable")  # words of a block stay in the order walked
    row, place, pick = row[order], place[order], pick[order]
    packed, flat, begin = pick.astype(np.uint64) << _TOP, table.ravel(), row * table.shape[1] + place
    for s in range(2, len(COUNTS)):
        which = np.flatnonzero(pick == s)
        at, word = begin[which], packed[which]
        for k in range(int(COUNTS[s])):
            word |= flat[at + k] << np.uint64(k * int(BITS[s]))
        packed[which] = word
    n_words = np.bincount(row, minlength=n_blocks)
    escaped = np.flatnonzero(pick == ESCAPE)
    verbatim = np.bincount(row[escaped], minlength=n_blocks)
    packed[escaped] |= _within(verbatim).astype(np.uint64)
    offsets = np.zeros(n_blocks + 1, np.uint64)
    np.cumsum(n_words + verbatim, out=offsets[1:])
    words = np.zeros(int(offsets[-1]), np.uint64)
    first = offsets[:-1].astype(np.int64)
    words[first[row] + _within(n_words)] = packed
    words[(first + n_words)[row[escaped]] + _within(verbatim)] = table[row[escaped], place[escaped]]
    return b"".join(
        (
            _HEAD.pack(MAGIC, block, n, n_blocks), offsets.astype("<u8").tobytes(),
            verbatim.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
        )
    )


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the given counts, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _parts(piece: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    magic, block, n, n_blocks = _HEAD.unpack_from(piece)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b piece")
    at = _HEAD.size
    offsets = np.frombuffer(piece, "<u8", n_blocks + 1, at).astype(np.int64)
    at += 8 * (n_blocks + 1)
    verbatim = np.frombuffer(piece, "<u4", n_blocks, at).astype(np.int64)
    at += 4 * n_blocks
    return block, n, offsets, verbatim, np.frombuffer(piece, "<u8", int(offsets[-1]), at)


def _unpacked(words: np.ndarray, first: np.ndarray, n_words: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The numbers of some blocks, whose packed words begin at ``first``; each has ``held`` numbers."""
    row = np.repeat(np.arange(len(first)), n_words)
    packed = words[first[row] + _within(n_words)]
    pick = (packed >> _TOP).astype(np.int64)
    counts = COUNTS[pick]
    # Where each word's numbers begin in its block, and so in the output.
    before = np.cumsum(counts) - counts
    begin_row = np.cumsum(n_words) - n_words
    place = before - (before[np.minimum(begin_row, len(before) - 1)][row] if len(before) else 0)
    out_first = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    for s in range(2, len(COUNTS)):
        which = np.flatnonzero(pick == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            inside = which[place[which] + k < held[row[which]]]
            value = (packed[inside] >> np.uint64(k * int(BITS[s]))) & mask
            out[out_first[row[inside]] + place[inside] + k] = value
    escaped = np.flatnonzero(pick == ESCAPE)
    source = (first + n_words)[row[escaped]] + (packed[escaped] & _LOW).astype(np.int64)
    out[out_first[row[escaped]] + place[escaped]] = words[source]
    return out


def decode(piece: bytes) -> np.ndarray:
    """All numbers of a piece."""
    block, n, offsets, verbatim, words = _parts(piece)
    held = np.full(len(verbatim), block)
    if len(held):
        held[-1] = n - (len(held) - 1) * block
    return _unpacked(words, offsets[:-1], np.diff(offsets) - verbatim, held)


def decode_block(piece: bytes, number: int) -> np.ndarray:
    """The numbers of one block alone."""
    block, n, offsets, verbatim, words = _parts(piece)
    one = slice(number, number + 1)
    held = np.array([min(block, n - number * block)])
    return _unpacked(words, offsets[:-1][one], (np.diff(offsets) - verbatim)[one], held)
