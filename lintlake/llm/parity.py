"""Parities of hashed sets: a lower bound for how much two sets differ, exact up to collisions of bits."""

from __future__ import annotations

import numpy as np


def parities(shingles: np.ndarray, bits: int = 4) -> bytes:
    """A bit for the parity of the number of shingles with each value of the last bits; ``bits`` to twice as many a shingle.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    width = max(64, bits << len(shingles).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(rows: list[bytes], width: int) -> np.ndarray:
    """Parities cut down to ``width`` bytes (64-bit words, a row each)."""
    out = np.zeros((len(rows), width // 8), dtype=np.uint64)
    for i, row in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(row, dtype=np.uint64).reshape(-1, width // 8), axis=0)
    return out


class Parities:
    """Parities of many sets, to be compared pair by pair whatever their widths."""

    def __init__(self, rows: list[bytes]):
        width = np.array([len(r) for r in rows], dtype=np.int64)
        self.width, self.row, self.own = width, np.zeros(len(rows), dtype=np.int64), {}
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            self.row[mine] = np.arange(len(mine))
            self.own[w] = np.frombuffer(b"".join(rows[i] for i in mine), dtype=np.uint64).reshape(-1, w // 8)
        self.cut: dict[tuple[int, int], np.ndarray] = {}

    def _at(self, width: int, to: int) -> np.ndarray:
        if width == to:
            return self.own[width]
        if (width, to) not in self.cut:
            wide = self.own[width]
            self.cut[(width, to)] = np.bitwise_xor.reduce(wide.reshape(len(wide), -1, to // 8), axis=1)
        return self.cut[(width, to)]

    def gaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the pairs (i, j) differ."""
        out = np.zeros(len(i), dtype=np.int64)
        kind = self.width[i] * (1 << 32) + self.width[j]
        for k in np.unique(kind).tolist():
            a, b = k >> 32, k & 0xFFFFFFFF
            to, mine = min(a, b), np.flatnonzero(kind == k)
            step = max(1, (1 << 22) // to)
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                x = self._at(a, to)[self.row[i[part]]] ^ self._at(b, to)[self.row[j[part]]]
                out[part] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        return out
