"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is an interpolated bigram model with absolute discounting.  With c(v, w) the training count of w after v, C(v)
their sum over w and T(v) the number of distinct w,

    P(w | v) = max(c(v, w) - D, 0) / (C(v) + A) + (A + D T(v)) / (C(v) + A) * P(w),
    P(w)     = (c(w) + 1/2) / (N + (V + 1) / 2),

which sums to one over the training words and one unknown word.  A text's tokens are its words and one end; the first
follows a begin.

The trie is cut into shards by the hash of a context.  A shard holds flat levels: the contexts as an Elias-Fano
sequence, monotone pointers into the next level as another, successors as a third (each beside its context's number, which makes the
whole level monotone), and quantised log10 probabilities.  ``Trie`` searches the coded levels as they are, a successor
within its context's pointers alone.  The buffer may come from an Arrow column or a memory map; no file is mapped
here, as shards are built where they are asked: every batch of documents sends what n-grams it has, with counts from its
training documents, and gets their probabilities back, so neither the model nor any part of it is broadcast.

Defined cases: a null text has the end as its only token; a null id counts as the empty text in the split;
repeated rows each count; without training documents every word has the unknown word's probability.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm import batches, eliasfano, kernels

END, BEGIN = np.uint64(0x9C6F2E1D4B8A7053), np.uint64(0x51A7C3E98D02F46B)  # fixed names for the two marks
DISCOUNT, PRIOR = 0.8, 6.0
FOLDS, HELD = 5, 1
STEP = 4000  # codes for one unit of log10
ZERO = 65535  # the code of probability 0
SUCCESSOR_BITS = 40


def held_out(ids: pa.ChunkedArray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids.to_pylist()], bool)


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every token, its context, and where each document's tokens start."""
    data, offsets = kernels.column(texts)
    hashes, firsts, base = [], [0], 0
    for i, j in kernels.spans(offsets, kernels.BLOCK):
        w = kernels.words(data, offsets[i : j + 1], lower=True)
        hashes.append(np.insert(w.hashes, w.first[1:], END))
        firsts += (base + w.first[1:] + np.arange(1, j - i + 1)).tolist()
        base = firsts[-1]
    tok = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.array(firsts, np.int64)
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[first[:-1]] = BEGIN
    return tok, ctx, first


class Ngrams:
    """What a batch of documents has: its words and bigrams, with training counts, in the order of the trie."""

    def __init__(self, docs: pa.Table):
        tok, ctx, self.first = _tokens(docs.column("text"))
        self.held = held_out(docs.column("id"))
        train = np.repeat(~self.held, np.diff(self.first))
        self.words = np.unique(np.append(tok, BEGIN))
        self.tok, self.ctx = np.searchsorted(self.words, tok), np.searchsorted(self.words, ctx)
        self.word_count = np.bincount(self.tok[train], minlength=len(self.words))
        key = self.ctx.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | tok >> np.uint64(64 - SUCCESSOR_BITS)
        keys, self.pair = np.unique(key, return_inverse=True)
        self.pair_count = np.bincount(self.pair[train], minlength=len(keys))
        self.pointer = np.searchsorted(keys >> np.uint64(SUCCESSOR_BITS), np.arange(len(self.words) + 1, dtype=np.uint64))
        self.successor = keys & np.uint64((1 << SUCCESSOR_BITS) - 1)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(buffer, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(buffer, np.uint8, 5 * n, at).reshape(n, 5)
    return out.view(np.uint64).ravel()


class Trie:
    """One shard's levels in a flat buffer."""

    @staticmethod
    def build(words: np.ndarray, word_count: np.ndarray, pointer: np.ndarray, successor: np.ndarray, pair_count: np.ndarray, discount: float, prior: float) -> bytes:
        """From sorted contexts and, within each, sorted successors, with training counts."""
        of = np.repeat(np.arange(len(words)), np.diff(pointer))
        total = np.bincount(of, pair_count, len(words))
        kinds = np.bincount(of, pair_count > 0, len(words))
        rest = np.where(total > 0, (prior + discount * kinds) / (total + prior), 1.0)
        p = np.maximum(pair_count - discount, 0) / (total[of] + prior)
        with np.errstate(divide="ignore"):
            code = np.where(p > 0, np.minimum(np.rint(-np.log10(p) * STEP), ZERO - 1), ZERO).astype(np.uint16)
        back = np.minimum(np.rint(-np.log10(rest) * STEP), ZERO - 1).astype(np.uint16)
        level = of.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor
        parts = [eliasfano.encode(words), eliasfano.encode(pointer.astype(np.uint64)), word_count.astype(np.uint64).tobytes(), back.tobytes(), eliasfano.encode(level), code.tobytes()]
        return np.array([len(x) for x in parts], np.uint64).tobytes() + b"".join(parts)

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, np.uint64, 6).astype(np.int64)
        at = 48 + np.concatenate(([0], np.cumsum(sizes)))
        view = memoryview(buffer)
        self.words, self.pointer, self.level = (eliasfano.Sequence(view[at[i] : at[i + 1]]) for i in (0, 1, 4))
        self.word_count = np.frombuffer(view, np.uint64, len(self.words), at[2])  # of the whole corpus, so it may pass 2**32
        self.back = np.frombuffer(view, np.uint16, len(self.words), at[3])
        self.code = np.frombuffer(view, np.uint16, len(self.level), at[5])

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the first level, -1 for those it lacks."""
        return self.words.search(words, np.zeros(len(words), np.int64), np.full(len(words), len(self.words)))

    def follow(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of successors, searched for within their contexts' ranges alone; ZERO for those that never followed."""
        out = np.full(len(successor), ZERO, np.uint16)
        known = np.flatnonzero(context >= 0)
        c = context[known]
        begin, end = (self.pointer[c + k].astype(np.int64) for k in (0, 1))
        at = self.level.search(c.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor[known], begin, end)
        out[known[at >= 0]] = self.code[at[at >= 0]]
        return out


def ask(shards: int):
    def run(docs: pa.Table) -> list[tuple[int, bytes]]:
        g = Ngrams(docs)
        made = []
        for s, a, b in batches.runs(g.words, shards):
            lo, hi = g.pointer[a], g.pointer[b]
            made.append((s, batches.pack(eliasfano.encode(g.words[a:b]), g.word_count[a:b].astype(np.uint32), np.diff(g.pointer[a : b + 1]).astype(np.uint32), _five(g.successor[lo:hi]), g.pair_count[lo:hi].astype(np.uint32))))
        return made

    return run


def answer(discount: float, prior: float):
    def run(numbers: list[int], messages: list) -> list[bytes]:
        asked = []
        for m in messages:
            words, count, kids, five, pairs = batches.unpack(m, bytes, np.uint32, np.uint32, bytes, np.uint32)
            asked.append((eliasfano.decode(words)[0], count, kids, _from_five(five, len(pairs), 0), pairs))
        words = np.unique(np.concatenate([a[0] for a in asked]))
        count, keys, pairs = np.zeros(len(words), np.int64), [], []
        for w, c, kids, succ, n in asked:
            at = np.searchsorted(words, w)
            count[at] += c
            seen = n > 0
            keys.append((np.repeat(at, kids).astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | succ)[seen])
            pairs.append(n[seen])
        key, n = np.concatenate(keys), np.concatenate(pairs)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(n.astype(np.int64), head) if len(key) else np.zeros(0, np.int64)
        key = key[head]
        pointer = np.searchsorted(key >> np.uint64(SUCCESSOR_BITS), np.arange(len(words) + 1, dtype=np.uint64))
        trie = Trie(Trie.build(words, count, pointer, key & np.uint64((1 << SUCCESSOR_BITS) - 1), sums, discount, prior))
        replies = []
        for w, _, kids, succ, _ in asked:
            at = trie.find(w)
            replies.append(batches.pack(trie.word_count[at], trie.back[at], trie.follow(np.repeat(at, kids), succ)))
        return replies

    return run


def finish(total: int, distinct: int):
    def run(number: int, docs: pa.Table, replies: list) -> pa.Table:
        g = Ngrams(docs)
        got = [batches.unpack(m, np.uint64, np.uint16, np.uint16) for m in replies]
        count, back, code = (np.concatenate([x[i] for x in got]).astype(np.float64) for i in range(3))
        base = np.log10(count + 0.5) - np.log10(total + 0.5 * (distinct + 1))
        seen = np.where(code < ZERO, 10 ** (-code / STEP), 0.0)
        logp = np.log10(seen[g.pair] + 10 ** (-back[g.ctx] / STEP) * 10 ** base[g.tok])
        n = np.diff(g.first)
        add = lambda x: np.add.reduceat(x, g.first[:-1]) if len(n) else np.zeros(0)  # noqa: E731  every document has a token
        return pa.table(
            {
                "id": docs.column("id"),
                "held_out": pa.array(g.held),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(add((count[g.tok] > 0).astype(np.int64)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), total, np.int64)),
                "base_score": pa.array(add(base[g.tok])),
                "score": pa.array(add(logp)),
            }
        )

    return run


def vocabulary(docs: DataFrame, id_col: str, text_col: str, shards: int) -> tuple[int, int]:
    """Training tokens, and how many of them are distinct."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def partial(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in incoming:
            _, offsets = kernels.column(whole.column(1))
            for i, j in kernels.spans(offsets, 4 * batches.BATCH_BYTES):
                docs = pa.Table.from_batches([whole.slice(i, j - i)])
                tok, _, first = _tokens(docs.column("text"))
                tok = tok[np.repeat(~held_out(docs.column("id")), np.diff(first))]
                own = np.unique(tok)
                some = batches.runs(own, shards)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in some], pa.int32()), pa.array([eliasfano.encode(own[a:b]) for _, a, b in some], pa.binary()), pa.array([len(tok) if k == 0 else 0 for k in range(len(some))], pa.int64())], names=["shard", "words", "tokens"])

    def final(t: pa.Table) -> pa.Table:
        words = [eliasfano.decode(x.as_buffer())[0] for x in t.column("words")]
        return pa.table({"tokens": pa.array([sum(t.column("tokens").to_pylist())], pa.int64()), "distinct": pa.array([len(np.unique(np.concatenate(words)))], pa.int64())})

    got = src.mapInArrow(partial, "shard int, words binary, tokens long").groupBy("shard").applyInArrow(final, "tokens long, distinct long")
    row = got.agg(F.sum("tokens"), F.sum("distinct")).first()
    return row[0] or 0, row[1] or 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, prior: float = PRIOR) -> DataFrame:
    """For every row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 P of the text)."""
    shards = batches.shards_for(docs, text_col)
    total, distinct = vocabulary(docs, id_col, text_col, shards)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = batches.exchange(batches.packed(docs, id_col, text_col), shards, ask(shards), answer(discount, prior), finish(total, distinct), schema)
    return out.withColumnRenamed("id", id_col)
