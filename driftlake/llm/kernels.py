"""NumPy kernels over the bytes of an Arrow string column.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; the separators are ASCII, so words can be
found on UTF-8 bytes.  Words and word windows are named by 64-bit hashes, made of non-linear mixing steps alone
(sums or polynomials modulo 2**64 cancel on regular texts), so that a batch costs a few passes over its words and no
Python object per word.
"""

from __future__ import annotations

import ctypes
from functools import wraps
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20  # bytes (or words) that are worked on at a time
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def give_back() -> None:
    """Gives freed memory back to the system.  Python workers outlive their tasks, and without this each keeps the most that any task
    took, also while a later stage needs the executor's memory elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving back what its task took."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_ODD, _START = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
LONG_WORD = 64  # bytes beyond which a word is hashed by itself


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a followed by b, for arrays of hashes."""
    return mix(a * _ODD + (b ^ _START))


def _named(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of text[s:e] for each word: eight bytes at a time, mixed one after the other."""
    size = e - s
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(U) + _START)
    long = size > LONG_WORD
    at = np.flatnonzero(~long)
    for k in range(0, LONG_WORD, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mix(out[at] ^ (eight[s[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(text[s[i] : e[i]].tobytes())
    return out


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one a word
    starts: np.ndarray  # byte where each word starts in the column's data
    ends: np.ndarray
    first: np.ndarray  # documents + 1: where each document's words start


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    if values.null_count:
        values = pc.fill_null(values, b"")
    _, off, data = values.buffers()
    offsets = np.frombuffer(off, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """The words of documents data[offsets[i]:offsets[i+1]]."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = data[lo:hi]
    space = _SPACE[text]
    before, after = np.ones(len(text), bool), np.ones(len(text), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
    before[cuts], after[cuts - 1] = True, True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    hashes = _named(_LOWER[text] if lower else text, starts, ends) if hashed else np.empty(0, U)
    return Words(hashes, starts + lo, ends + lo, np.searchsorted(starts, offsets - lo))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of hashes[i:i+k] for every i, without regard to documents.

    Runs of 1, 2, 4, ... words are joined pair by pair and put together to k: no sum or product over a window that
    patterns in the text could cancel."""
    n = len(hashes) - k + 1
    out = np.empty(max(n, 0), U)
    for i in range(0, n, BLOCK // 4):
        run = hashes[i : min(i + BLOCK // 4, n) + k - 1]
        m, made, width, size = len(run) - k + 1, None, 0, 1
        while True:
            if k & size:
                made = run[:] if made is None else join(made[: len(run) - width], run[width:])
                width += size
            if 2 * size > k:
                break
            run = join(run[:-size], run[size:])
            size *= 2
        out[i : i + m] = mix(made[:m] + U(k))
    return out


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For every window start of windows(): does the window lie within one document?"""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))  # each word's document's end
    return np.arange(max(0, n - k + 1)) + k <= last[: max(0, n - k + 1)]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts documents into runs of at most `most` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's bigint."""
    return x.view(np.int64)
