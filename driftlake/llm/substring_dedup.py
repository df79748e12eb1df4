"""Removal of repeated passages by relative Lempel-Ziv parsing against an index of the whole corpus.

The reference is the corpus itself, in blocks (the batches that documents are packed in).  Every phrase of `window` words is
indexed with its place, a block and a word in it; the index is cut into shards by the phrases' hashes.  Each document is
factored greedily against all blocks: a factor begins at the first word whose phrase also starts elsewhere, takes that phrase's first
other place as its source, and grows as long as the next phrase has its place one word further in the same
block.  Where a factor ends, the phrase at the next word is looked up like any other, and if it is repeated a new factor begins
that overlaps the last one: so a phrase that spans two factors is found, which a plain greedy parse would miss.
Factors are at least `window` words long, and all their words are duplicate spans and are removed.

A shard gets each phrase once a block, so a passage that a third of all documents share costs a shard no more than one entry a
block.  Phrases are told apart by 88 bits of hash: of 10**13 phrases two different ones would meet with a probability of 1 in 6, of 10**12
of 1 in 600.

Defined cases: a null text has no words; documents shorter than the window keep all words; equal rows lose everything
if they are long enough; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm import batches, eliasfano, kernels

WINDOW = 35
PIECE = 1 << 17  # phrases of a shard that are sorted at a time
STEP = 1 << 16  # words that are copied at a time


class Phrases(NamedTuple):
    words: kernels.Words
    data: np.ndarray
    starts: np.ndarray  # the word at which each phrase starts
    which: np.ndarray  # its place among the distinct ones
    high: np.ndarray  # the distinct phrases' hashes, in order
    low: np.ndarray
    first: np.ndarray  # the word at which each distinct phrase first starts
    second: np.ndarray  # and for the second time, or -1


def phrases(texts: pa.Array, window: int) -> Phrases:
    data, offsets = kernels.column(texts)
    w = kernels.words(data, offsets)
    starts = np.flatnonzero(kernels.inside(w.first, window))
    high = kernels.windows(w.hashes, window)[starts] & ~np.uint64(255)  # 56 bits, which cost a byte less each in Elias-Fano form
    low = (kernels.windows(kernels.mix(w.hashes + np.uint64(window)), window)[starts] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((starts, low, high))
    h, k = high[order], low[order]
    head = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))[: len(h)]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    second = np.full(len(at), -1)
    again = np.append(at[1:], len(h)) - at > 1
    second[again] = starts[order[at[again] + 1]]
    return Phrases(w, data, starts, which, h[at], k[at], starts[order[at]], second)


def ask(window: int, shards: int):
    def run(docs: pa.Table) -> list[tuple[int, bytes]]:
        p = phrases(docs.column("text"), window)
        return [(s, batches.pack(eliasfano.encode(p.high[a:b] >> np.uint64(8)), p.low[a:b], p.first[a:b].astype(np.uint32))) for s, a, b in batches.runs(p.high, shards)]

    return run


def answer(numbers: list[int], messages: list) -> list[bytes]:
    """For each block's phrases of this shard: does another block have it, and which place of another block comes first?

    Questions are in the order of hashes, so the shard is gone through by ranges of hashes, and only a range's phrases are sorted at a time."""
    sizes = [eliasfano.length(batches.unpack(m, bytes)[0]) for m in messages]
    ends = np.cumsum(sizes, dtype=np.int64)
    begins, n = ends - sizes, sum(sizes)
    high, low, first = np.empty(n, np.uint64), np.empty(n, np.uint32), np.empty(n, np.uint32)
    for a, b, m in zip(begins, ends, messages):
        hashes, low[a:b], first[a:b] = batches.unpack(m, bytes, np.uint32, np.uint32)
        high[a:b] = eliasfano.decode(hashes)[0] << np.uint64(8)
    found, who, place = np.zeros(n, bool), np.empty(n, np.uint32), np.empty(n, np.uint32)  # who, place: only where found
    number = np.array(numbers, np.int64)
    for piece in _ranges(high, begins, ends):
        h, k = high[piece], low[piece]
        asks = np.searchsorted(ends, piece, "right")
        order = np.lexsort((number[asks], k, h))
        h, k = h[order], k[order]
        head = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))
        at = np.flatnonzero(head)
        times = np.diff(at, append=len(h))
        hit = np.flatnonzero(np.repeat(times > 1, times))  # a block asks for a phrase once, so these are different blocks
        lead = np.repeat(at, times)[hit]
        source = order[np.where(head[hit], lead + 1, lead)]  # the first asks for the second, others for the first
        to = piece[order[hit]]
        found[to], who[to], place[to] = True, asks[source], first[piece[source]]
    replies = []
    for a, b in zip(begins, ends):
        has = found[a:b]
        replies.append(batches.pack(np.packbits(has), number[who[a:b][has]], place[a:b][has]))
    return replies


def _ranges(high: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The places of about PIECE hashes after each other, equal ones together; high[a:b] is in order for each of begins and ends."""
    if not len(high):
        return
    least, most = int(high.min()), int(high.max())
    parts = -(-len(high) // PIECE)
    at = begins.copy()
    for i in range(1, parts + 1):
        cut = np.uint64(least + (most - least) * i // parts)
        to = ends if i == parts else np.array([a + np.searchsorted(high[a:b], cut) for a, b in zip(at, ends)], np.int64)
        sizes = to - at
        if sizes.any():
            yield np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        at = to


class Factors(NamedTuple):
    begin: np.ndarray  # word at which each factor begins
    end: np.ndarray  # the word after its last
    block: np.ndarray  # where its source begins
    place: np.ndarray


def parse(number: int, p: Phrases, replies: list, shards: int, window: int) -> Factors:
    """The factors of a block's documents, from the replies of all shards."""
    block, place = np.full(len(p.high), -1, np.int64), np.zeros(len(p.high), np.int64)
    for (_, a, b), m in zip(batches.runs(p.high, shards), replies):
        bits, blocks, firsts = batches.unpack(m, np.uint8, np.int64, np.uint32)
        at = a + np.flatnonzero(np.unpackbits(bits, count=b - a))
        block[at], place[at] = blocks, firsts
    own_first = p.starts == p.first[p.which]
    b, at = block[p.which], place[p.which]
    within = np.where(own_first, p.second[p.which], p.first[p.which])  # the phrase's other place in this block, if it has one
    inner = (within >= 0) & ((b < 0) | (number < b))
    b, at = np.where(inner, number, b), np.where(inner, within, at)
    hit = np.flatnonzero(b >= 0)
    if not len(hit):
        none = np.zeros(0, np.int64)
        return Factors(none, none, none, none)
    s, b, at = p.starts[hit], b[hit], at[hit]
    grows = (s[1:] == s[:-1] + 1) & (b[1:] == b[:-1]) & (at[1:] == at[:-1] + 1)
    doc = np.searchsorted(p.words.first, s, "right")
    head = np.append(True, ~(grows & (doc[1:] == doc[:-1])))
    tail = np.append(head[1:], True)
    return Factors(s[head], s[tail] + window, b[head], at[head])


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def finish(window: int, shards: int, texts_too: bool, factors_too: bool = False):
    def run(number: int, docs: pa.Table, replies: list) -> pa.Table:
        p = phrases(docs.column("text"), window)
        found = parse(number, p, replies, shards, window)
        w, data = p.words, p.data
        del p
        keep = ~_covered(len(w.starts), found.begin, found.end)
        s, e = w.starts[keep], w.ends[keep]
        sizes = e - s + 1
        place = np.concatenate(([0], np.cumsum(sizes)))
        joined = np.empty(int(place[-1]), np.uint8)
        for i in range(0, len(s), STEP):
            size, at = sizes[i : i + STEP], place[i : i + STEP + 1]
            flat = np.repeat(s[i : i + STEP] - at[:-1], size) + np.arange(at[0], at[-1])
            joined[at[0] : at[-1]] = data[np.minimum(flat, len(data) - 1)]
        joined[place[1:] - 1] = 0x20
        left = np.concatenate(([0], np.cumsum(keep)))[w.first]  # kept words before each document
        n = np.diff(w.first)
        kept = []
        view = joined.tobytes()
        for a, b in zip(left, left[1:]):
            kept.append(view[place[a] : place[b] - 1] if b > a else b"")
        cols = {"id": docs.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(left), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if texts_too:
            removed = (n - np.diff(left)).tolist()
            cols["kept_text"] = pa.array([k.decode() if r else (t or "") for k, r, t in zip(kept, removed, docs.column("text").to_pylist())], pa.string())
        if factors_too:
            ends = np.searchsorted(found.begin, w.first).astype(np.int32)
            begins = found.begin - w.first[np.searchsorted(w.first, found.begin, "right") - 1] if len(found.begin) else found.begin
            one = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begins, found.end - found.begin, found.block, found.place)], names=["start", "length", "source_block", "source_word"])
            cols["factors"] = pa.ListArray.from_arrays(pa.array(ends), one)
            cols["block"] = pa.array([number] * docs.num_rows, pa.int64())
            cols["block_word"] = pa.array(w.first[:-1], pa.int64())
        cols |= {c: docs.column(c) for c in docs.column_names[2:]}
        return pa.table(cols)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False, factors: bool = False, others: Sequence[str] = ()) -> DataFrame:
    """For every row: id_col, n_words, n_removed, kept_sha256 (of the kept words joined by one space), with texts=True also
    kept_text (the text itself if nothing is removed, else the kept words joined by one space), with factors=True also its
    factors (start and length in words, source_block, source_word) and where its own words stand (block, block_word), and `others`."""
    shards = batches.shards_for(docs, text_col)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"id {kind[id_col]}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    if factors:
        schema += ", factors array<struct<start:bigint,length:bigint,source_block:bigint,source_word:bigint>>, block long, block_word long"
    schema += "".join(f", o{i} {kind[c]}" for i, c in enumerate(others))
    out = batches.exchange(batches.packed(docs, id_col, text_col, others), shards, ask(window, shards), answer, finish(window, shards, texts, factors), schema)
    return out.withColumnsRenamed({"id": id_col, **{f"o{i}": c for i, c in enumerate(others)}})


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages taken out of text_col; its other columns stay (n_chars, if there, follows the text)."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    out = dedup(docs, id_col, text_col, texts=True, others=others).drop("n_words", "n_removed", "kept_sha256").withColumnRenamed("kept_text", text_col)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
