"""Monotone integer sequences in Elias-Fano form: low bytes as they are, high parts in unary.

The form is one flat buffer read in place with np.frombuffer, so it serves for bytes, Arrow buffers and memory maps.  ``Sequence``
searches it as it is: the i-th value is a select on the unary part beside the i-th low bytes."""

from __future__ import annotations

import numpy as np

HEAD = 4  # 64-bit fields: length, low bytes, first value, bits of the unary part


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing uint64 array as bytes."""
    n = len(values)
    if not n:
        return np.zeros(HEAD, np.uint64).tobytes()
    v = values - values[0]
    top, low = int(v[-1]), 0
    while top >> 8 * low > 8 * n:
        low += 1
    high = (v >> np.uint64(8 * low)).astype(np.int64) if low < 8 else np.zeros(n, np.int64)
    bits = np.zeros(int(high[-1]) + n, np.uint8)
    bits[high + np.arange(n)] = 1
    head = np.array([n, low, values[0], len(bits)], np.uint64)
    return head.tobytes() + np.ascontiguousarray(v.view(np.uint8).reshape(n, 8)[:, :low]).tobytes() + np.packbits(bits, bitorder="little").tobytes()


def length(buffer) -> int:
    """How many values an encoded sequence has."""
    return int(np.frombuffer(buffer, np.uint64, 1)[0])


def decode(buffer) -> tuple[np.ndarray, int]:
    """The values, and how many bytes of the buffer they took."""
    n, low, first, bits = (int(x) for x in np.frombuffer(buffer, np.uint64, HEAD))
    at = 8 * HEAD
    if not n:
        return np.zeros(0, np.uint64), at
    v = np.zeros((n, 8), np.uint8)
    v[:, :low] = np.frombuffer(buffer, np.uint8, n * low, at).reshape(n, low)
    at += n * low
    packed = np.frombuffer(buffer, np.uint8, (bits + 7) // 8, at)
    high = (np.flatnonzero(np.unpackbits(packed, count=bits, bitorder="little")) - np.arange(n)).astype(np.uint64)
    values = v.view(np.uint64).ravel()
    if low < 8:
        values = values + (high << np.uint64(8 * low))
    return values + np.uint64(first), at + (bits + 7) // 8


class Sequence:
    """An encoded sequence, read in place.  Beside the buffer it holds a count of ones for each 64 bits of the unary part."""

    def __init__(self, buffer):
        self.n, self.low, first, bits = (int(x) for x in np.frombuffer(buffer, np.uint64, HEAD))
        self.first, at = np.uint64(first), 8 * HEAD
        self.lows = np.frombuffer(buffer, np.uint8, self.n * self.low, at).reshape(self.n, self.low)
        at += self.n * self.low
        raw = np.frombuffer(buffer, np.uint8, (bits + 7) // 8, at)
        self.size = at + len(raw)
        self.unary = np.concatenate((raw, np.zeros(-len(raw) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.unary), dtype=np.int64)))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        index = np.asarray(index, np.int64)
        word = np.searchsorted(self.before, index, "right") - 1
        rest, bits, place = index - self.before[word], self.unary[word], np.zeros(len(index), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # where the one number `rest` of the 64 bits stands
            half = bits & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(half).astype(np.int64)
            above = rest >= ones
            rest, place = rest - ones * above, place + width * above
            bits = np.where(above, bits >> np.uint64(width), half)
        high = (64 * word + place - index).astype(np.uint64)
        value = np.zeros((len(index), 8), np.uint8)
        value[:, : self.low] = self.lows[index]
        value = value.view(np.uint64).ravel()
        if self.low < 8:
            value = value + (high << np.uint64(8 * self.low))
        return value + self.first

    def search(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each value the place in [lo, hi) at which it stands, or -1."""
        end, lo, hi = hi, lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = self[mid] < values[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        found = np.full(len(values), -1)
        at = np.flatnonzero(lo < end)
        at = at[self[lo[at]] == values[at]]
        found[at] = lo[at]
        return found
