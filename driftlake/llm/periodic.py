"""Periodic runs of words: stretches that repeat a shorter one at least three times over.

A run is a stretch of consecutive words with smallest period q and length of at least max(LEAST, TIMES * q) which no neighbour extends.
Every run holds, under one of the two orders of words, a Lyndon word of length q at which a longest Lyndon word begins.  So a stack is
scanned from right to left under both orders for the longest Lyndon word at each place; the comparisons that this takes, and the
extension of a Lyndon word to a run, are longest common extensions, found by binary search over rolling hashes.  Words are compared as
numbers, and every run's words are compared directly before it counts: a hash that errs can't make a run.

Where nothing recurs there is nothing to scan: in a run each stretch of WINDOW words stands a second time in the document (a run is no
shorter than 3 * WINDOW, nor than three periods), so only stretches of places whose windows recur are scanned.

Each document is worked on by itself, with no shuffle; memory is in proportion to a document.

Defined cases: a null or empty text, and one without runs, has no runs and null for the run; a row without an id isn't edited; equal
rows get equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftlake.llm import kernels

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
WINDOW = LEAST // TIMES
TEXT_BYTES = 4 << 20
PRIME = (1 << 61) - 1
BASE = 0x1B873593_CC9E2D51 % PRIME

Run = tuple[int, int, int]  # start, length, period


class Extensions:
    """Longest common extensions of a sequence of numbers, by hashes of its prefixes."""

    def __init__(self, x: Sequence[int]):
        self.x = x
        self.sums, self.powers = [0], [1]
        for v in x:
            self.sums.append((self.sums[-1] * BASE + v + 1) % PRIME)
            self.powers.append(self.powers[-1] * BASE % PRIME)

    def same(self, i: int, j: int, n: int) -> bool:
        s, p = self.sums, self.powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % PRIME == 0

    def _search(self, lo: int, most: int, same) -> int:
        """The greatest n up to `most` for which same(n), known for lo; steps double before they are halved."""
        step = 4
        while lo + step <= most and same(lo + step):
            lo += step
            step *= 2
        hi = min(most + 1, lo + step)  # not the same, or beyond the end
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if same(mid) else (lo, mid)
        return lo

    def forward(self, i: int, j: int) -> int:
        """How many words from i and from j > i on are equal."""
        x, n = self.x, len(self.x) - j
        if n <= 0 or x[i] != x[j]:
            return 0
        return self._search(1, n, lambda k: self.same(i, j, k))

    def backward(self, i: int, j: int) -> int:
        """How many words before i and before j > i are equal."""
        x = self.x
        if not i or x[i - 1] != x[j - 1]:
            return 0
        return self._search(1, i, lambda k: self.same(i - k, j - k, k))


def longest_lyndon(ext: Extensions, up: bool) -> list[int]:
    """For each place the end of the longest Lyndon word that begins there, under the ascending or the descending order."""
    x, n = ext.x, len(ext.x)
    ends = [0] * n  # those of places that may still be asked for form a stack, linked by ends
    for i in range(n - 1, -1, -1):
        j = i + 1
        while j < n:
            k = ext.forward(i, j)
            if j + k == n or (x[i + k] > x[j + k]) == up:
                break
            j = ends[j]
        ends[i] = j
    return ends


def find(x: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of x, by start, then period."""
    ext, n = Extensions(x), len(x)
    found: set[Run] = set()
    last: dict[int, tuple[int, int]] = {}  # period: the run found last
    for up in (True, False):
        ends = longest_lyndon(ext, up)
        last.clear()
        for i in range(n - 1, -1, -1):
            p = ends[i] - i
            if i + (times - 1) * p > n or times > 2 and x[i] != x[i + p]:
                continue
            if p in last and last[p][0] <= i and i + p <= last[p][1]:
                continue  # runs of one period share less than it
            right = i + p + ext.forward(i, i + p)
            if right < i + (times - 1) * p:
                continue  # the run's first Lyndon word stands times - 1 times in it
            left = i - ext.backward(i, i + p)
            last[p] = left, right
            if right - left >= max(least, times * p) and x[left : right - p] == x[left + p : right]:
                found.add((left, right - left, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def recurring(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, begin, end) of stretches of words whose windows all stand elsewhere in their document, too."""
    if len(hashes) < WINDOW:
        return []
    inside = np.flatnonzero(kernels.inside(first, WINDOW))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[inside]
    named = kernels.join(kernels.windows(hashes, WINDOW)[inside], doc.astype(np.uint64))
    order = np.argsort(named, kind="stable")
    equal = named[order][1:] == named[order][:-1]
    again = np.zeros(len(named), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    place, of = inside[at], doc[at]
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(of) != 0))
    begin, end = place[np.append(0, cut + 1)], place[np.append(cut, len(place) - 1)] + WINDOW
    return [(d, b, e) for d, b, e in zip(of[np.append(0, cut + 1)].tolist(), begin.tolist(), end.tolist()) if e - b >= LEAST]


def edited(n: int, doc_id: str | None) -> tuple[int, int] | None:
    """(a, p) if the contract's edit makes the words from a on repeat with period p."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(doc_id.encode())
    g, a = h // 10, h // 10 % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


def _batch(ids: list[str | None], texts: pa.Array) -> list[tuple]:
    data, offsets = kernels.column(texts)
    w = kernels.words(data, offsets)
    place = np.arange(len(w.hashes))
    for d, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if edit := edited(hi - lo, ids[d]):
            a, p = edit
            place[lo + a : hi] = lo + a + np.arange(hi - lo - a) % p
    runs: list[list[Run]] = [[] for _ in ids]
    for d, b, e in recurring(w.hashes[place], w.first):
        names: dict[bytes, int] = {}
        spelled = [data[s:t].tobytes() for s, t in zip(w.starts[place[b:e]].tolist(), w.ends[place[b:e]].tolist())]
        base = b - int(w.first[d])
        runs[d] += [(base + s, n, p) for s, n, p in find([names.setdefault(v, len(names)) for v in spelled])]
    out = []
    for d, found in enumerate(runs):
        raw = data[offsets[d] : offsets[d + 1]].tobytes().split()  # at the six ASCII white spaces, as words are
        lo = int(w.first[d])
        words = [raw[i - lo] for i in place[lo : lo + len(raw)].tolist()] if edited(len(raw), ids[d]) else raw
        if found:
            keep = np.ones(len(words), bool)
            for s, n, p in found:
                keep[s + p : s + n] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        best = _best(found)
        out.append((sorted(found, key=lambda r: (r[0], r[2])), best, b" ".join(words)))
    return out


def _best(found: list[Run]) -> Run | None:
    """The run of most periods; ties go to the least start, then the least period."""
    best = None
    for r in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_runs; start, length, period, exponent_milli of the run of most periods; runs_sha256, collapsed_sha256,
    and the runs (`start,length,period` lines) and collapsed text themselves.  Words are edited first, as the contract says."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField(id_col, kind), *StructType.fromDDL("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs string, collapsed string").fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = kernels.column(b.column(2))
            for i, j in kernels.spans(offsets, TEXT_BYTES):
                rows: list[list] = [[] for _ in names[1:]]
                for found, best, text in _batch(b.column(1).slice(i, j - i).to_pylist(), b.column(2).slice(i, j - i)):
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                    s, n, p = best or (None, None, None)
                    for column, v in zip(rows, (len(found), s, n, p, best and 1000 * n // p, sha256(lines.encode()).hexdigest(), sha256(text).hexdigest(), lines, text.decode())):
                        column.append(v)
                kinds = [pa.int64()] * 5 + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(c, k) for c, k in zip(rows, kinds)]], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("named"), F.col(text_col).alias("text")).mapInArrow(run, schema)
