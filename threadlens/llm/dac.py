"""Directly addressable codes for token ids.

An id is cut into chunks, low bits first. Level k holds the k-th chunk of every id that has
one, a bitmap that says whether a further chunk follows, and the count of set bits before
each 512-bit block (the rank directory). Token i is found by one look-up per level: no
block of tokens is decoded. Chunks are 4 or 8 bits wide; the widths of a segment are those
that need the fewest bits for its ids.

File format of a segment, little-endian: magic ``DAC1``, uint8 number of levels L, L uint8
widths, L uint64 entry counts, then per level the chunks (4-bit chunks in pairs, low half
first), and for all levels but the last the bitmap (low bit first) and the directory
(uint32 per 512 bits).
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint32)


def choose_widths(ids: np.ndarray) -> tuple[int, ...]:
    """The widths with the least space; ids of up to 32 bits."""
    bits = np.frexp(ids.astype(np.float64))[1] if len(ids) else np.zeros(1, np.int64)
    most = max(1, int(bits.max(initial=1)))
    longer = [int((bits > b).sum()) for b in range(most + 9)]  # ids with more than b bits

    @lru_cache(maxsize=None)
    def best(done: int) -> tuple[float, tuple[int, ...]]:
        here = len(ids) if done == 0 else longer[done]
        found = []
        for width in (4, 8):
            if done + width >= most:
                found.append((here * width, (width,)))
            else:
                cost, rest = best(done + width)
                found.append((here * (width + 1 + 32 / BLOCK) + cost, (width, *rest)))
        return min(found)

    return best(0)[1]


def _directory(bitmap: np.ndarray) -> np.ndarray:
    ones = np.add.reduceat(_ONES[bitmap], np.arange(0, len(bitmap), BLOCK // 8)) if len(bitmap) else np.zeros(0)
    return np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")


def encode(ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint32)
    widths = choose_widths(ids)
    counts, parts, rest = [], [], ids
    for k, width in enumerate(widths):
        counts.append(len(rest))
        chunk = (rest & ((1 << width) - 1)).astype(np.uint8)
        if width == 4:
            chunk = np.append(chunk, np.zeros(len(chunk) % 2, np.uint8))
            chunk = chunk[0::2] | (chunk[1::2] << 4)
        parts.append(chunk.tobytes())
        if k + 1 < len(widths):
            rest = rest >> width
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            parts += [bitmap.tobytes(), _directory(bitmap).tobytes()]
            rest = rest[more]
    head = MAGIC + struct.pack("<B", len(widths)) + bytes(widths) + struct.pack(f"<{len(widths)}Q", *counts)
    return head + b"".join(parts)


class Segment:
    """Reads tokens of an encoded segment from its bytes, singly or by range."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        n = data[4]
        self.widths = list(data[5 : 5 + n])
        self.counts = list(struct.unpack_from(f"<{n}Q", data, 5 + n))
        at, self.levels = 5 + 9 * n, []
        raw = np.frombuffer(data, np.uint8)
        for k, (width, count) in enumerate(zip(self.widths, self.counts, strict=True)):
            size = -(-count * width // 8)
            chunks, at = raw[at : at + size], at + size
            bitmap = directory = None
            if k + 1 < n:
                size = -(-count // 8)
                bitmap, at = raw[at : at + size], at + size
                size = 4 * -(-count // BLOCK)
                directory, at = np.frombuffer(data, "<u4", size // 4, at), at + size
            self.levels.append((width, chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.counts[0]

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        if i == 0 or not len(bitmap):
            return 0
        block = min(i // BLOCK, len(directory) - 1)
        first, last = block * BLOCK // 8, i // 8
        ones = int(directory[block]) + int(_ONES[bitmap[first:last]].sum())
        return ones + (int(_ONES[bitmap[last] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """Token i by one look-up per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for width, chunks, bitmap, directory in self.levels:
            chunk = int(chunks[i]) if width == 8 else (int(chunks[i // 2]) >> (4 * (i % 2))) & 15
            value |= chunk << shift
            shift += width
            if bitmap is None or not (bitmap[i // 8] >> (i % 8)) & 1:
                break
            i = self._rank(bitmap, directory, i)
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop``; ranks locate the range on each level."""
        out, where, shift = np.zeros(stop - start, np.uint32), None, 0
        for width, chunks, bitmap, directory in self.levels:
            if stop <= start:
                break
            if width == 8:
                chunk = chunks[start:stop].astype(np.uint32)
            else:
                pairs = chunks[start // 2 : -(-stop // 2)]
                both = np.stack([pairs & 15, pairs >> 4], 1).ravel()
                chunk = both[start % 2 : start % 2 + stop - start].astype(np.uint32)
            if where is None:
                out |= chunk
            else:
                out[where] |= chunk << np.uint32(shift)
            shift += width
            if bitmap is None:
                break
            bits = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")
            more = bits[start % 8 : start % 8 + stop - start].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            start = self._rank(bitmap, directory, start)
            stop = start + int(more.sum())
        return out
