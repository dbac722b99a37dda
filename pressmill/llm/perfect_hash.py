"""A minimal perfect hash of 64-bit keys, built and looked up by whole arrays.

Keys are thrown into a bit table twice their number; those that fall alone keep
their bit, the others go on to a further, smaller table. The number of a key is
the count of bits before its own, over all tables: n keys get 0 to n - 1.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

ROOM = 2.0
WORD = 64


def mixed(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit keys (the finaliser of splitmix64), different per salt."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit tables with the number of bits before each word."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.before, total = [], 0
        for table in tables:
            counts = np.bitwise_count(table).astype(np.int64)
            self.before.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        tables, rest = [], np.asarray(keys, dtype=np.int64)
        while len(rest):
            words = max(1, int(np.ceil(ROOM * len(rest) / WORD)))
            places = (mixed(rest, len(tables)) % np.uint64(words * WORD)).astype(np.int64)
            held = np.bincount(places, minlength=words * WORD)
            alone = held[places] == 1
            bits = np.zeros(words * WORD, dtype=np.uint8)
            bits[places[alone]] = 1
            tables.append(np.packbits(bits, bitorder="little").view(np.uint64))
            rest = rest[~alone]
        return cls(tables)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for many that aren't held, some number for the others of these."""
        keys = np.asarray(keys, dtype=np.int64)
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, table in enumerate(self.tables):
            places = mixed(keys[open_], level) % np.uint64(len(table) * WORD)
            word, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            hit = (table[word] >> bit & np.uint64(1)).astype(bool)
            below = table[word] & ((np.uint64(1) << bit) - np.uint64(1))
            number = self.before[level][word] + np.bitwise_count(below)
            found[open_[hit]] = number[hit]
            open_ = open_[~hit]
        return found

    def to_bytes(self) -> bytes:
        """Number of levels, words of each, keys; then of every word its bits and the bits before it."""
        sizes = [len(table) for table in self.tables]
        out = [struct.pack(f"<{len(sizes) + 2}q", len(sizes), *sizes, self.size)]
        for table, before in zip(self.tables, self.before, strict=True):
            out.append(np.stack([table, before.view(np.uint64)], axis=1).astype("<u8").tobytes())
        return b"".join(out)

    @classmethod
    def number_at(cls, read_at: Callable[[int, int], bytes], key: int) -> tuple[int, int, int]:
        """The number of one key in a written hash (-1: not held), its keys, and where it ends; a read per level."""
        (levels,) = struct.unpack("<q", read_at(8, 0))
        *sizes, total = struct.unpack(f"<{levels + 1}q", read_at(8 * (levels + 1), 8))
        at, found = 8 * (levels + 2), -1
        for level, size in enumerate(sizes):
            if found < 0:
                place = int(mixed(np.array([key], dtype=np.int64), level)[0]) % (size * WORD)
                word, before = struct.unpack("<Qq", read_at(16, at + 16 * (place // WORD)))
                if word >> place % WORD & 1:
                    found = before + (word & (1 << place % WORD) - 1).bit_count()
            at += 16 * size
        return found, total, at

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and the number of bytes it takes."""
        (levels,) = struct.unpack_from("<q", data)
        sizes = struct.unpack_from(f"<{levels}q", data, 8)
        at, tables = 8 * (levels + 2), []
        for size in sizes:
            tables.append(np.frombuffer(data, dtype="<u8", count=2 * size, offset=at)[::2].copy())
            at += 16 * size
        return cls(tables), at
