"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read with the library's own protobuf; encoding and decoding are done here, on flat
NumPy symbol arrays.  Pieces never hold a space mark after another character, so a text falls into
units (space marks, then other characters) that merge on their own; a batch's distinct new units
are encoded together.  Each round takes every unit's best-scored pair, merges its occurrences from the
left, compacts the arrays, and drops units in which no pair is left.

Occurrences are merged at once only where that equals merging one by one: if a merge would make a
pair with a better score than the pair being merged, that unit merges its leftmost occurrence alone.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm import kernels

MARK = "▁"
NONE = np.int64(1 << 40)
CACHE = 100_000  # units of a generation; a worker remembers two of these, so memory is bounded


class Bpe:
    """A BPE model without normalisation rules, as written by the sentencepiece trainer."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are supported")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        self.unk = self.kinds.index(2)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4, 5)}
        letters = sorted({c for p in normal for c in p})
        own = dict(normal)  # letters that are no piece get numbers beyond the pieces
        for c in letters:
            own.setdefault(c, len(self.pieces) + len(own))
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.of_char[ord(c)] = own[c]
        self.size = max(own.values()) + 2
        scores = sorted({m.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = [(own[p[:k]] * self.size + own[p[k:]], rank[m.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        whole = all(MARK not in p.lstrip(MARK) for p in normal)
        line = "" if any("\n" in p for p in normal) else "\n"
        self.unit = re.compile((rf"{line}+|" if line else "") + rf"{MARK}*[^{MARK}{line}]+|{MARK}+" if whole else r"(?s).+")
        self.bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.unit.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without) and piece of each pair."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], NONE), np.where(ok, self.made[at], -1)

    def encode_units(self, units: Sequence[str]) -> list[list[int]]:
        """The ids of each non-empty unit."""
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        count = np.fromiter(map(len, units), np.int64, len(units))
        sym = self.of_char[flat].copy()
        start = np.concatenate(([0], np.cumsum(count)))
        sym = np.where(sym < 0, -2 - flat.astype(np.int64), sym).astype(np.int64)  # a stranger keeps its code point
        out: list[list[int] | None] = [None] * len(units)
        alive = np.arange(len(units))
        word = np.repeat(np.arange(len(units)), count)
        rank, made = self._pairs(sym, word)
        while len(alive):
            first = np.concatenate(([0], np.cumsum(count)))
            best = np.minimum.reduceat(rank, first[:-1])
            done = best == NONE
            if done.any():
                of = np.repeat(done, count)
                for u, ids in zip(alive[done], np.split(sym[of], np.cumsum(count[done])[:-1])):
                    out[u] = self._ids(ids)
                stay = ~of
                sym, rank, made = sym[stay], rank[stay], made[stay]
                alive, count, best = alive[~done], count[~done], best[~done]
                if not len(alive):
                    break
            word = np.repeat(np.arange(len(alive)), count)
            at = np.flatnonzero(rank == best[word])
            # of a chain of overlapping occurrences every other one counts, from its left end
            head = np.ones(len(at), bool)
            head[1:] = (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])
            begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            new, w = made[at], word[at]
            last = np.cumsum(count)[w] - 1  # the unit's last symbol
            right, _ = self.look_up(new, np.where(at + 2 <= last, sym[np.minimum(at + 2, len(sym) - 1)], -1))
            near = np.zeros(len(at), bool)
            near[1:] = (at[1:] - at[:-1] == 2) & (w[1:] == w[:-1])
            before = np.where(at > np.concatenate(([0], np.cumsum(count)))[w], sym[np.maximum(at - 1, 0)], -1)
            before[near] = new[np.flatnonzero(near) - 1]
            left, _ = self.look_up(before, new)
            risky = np.zeros(len(alive), bool)
            risky[w[(right < best[w]) | (left < best[w])]] = True
            if risky.any():
                lead = np.ones(len(at), bool)
                lead[1:] = w[1:] != w[:-1]
                at = at[lead | ~risky[w]]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            count = count - np.bincount(word[at], minlength=len(alive))
            to = (np.cumsum(keep) - 1)[at]
            sym, rank, made, word = sym[keep], rank[keep], made[keep], word[keep]
            for p in (to, to[to > 0] - 1):
                rank[p], made[p] = self._pairs(sym, word, p)
        return out

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        follow = np.minimum(at + 1, len(sym) - 1)
        same = (word[at] == word[follow]) & (follow > at)
        return self.look_up(sym[at], np.where(same, sym[follow], -1))

    def _ids(self, symbols: np.ndarray) -> list[int]:
        ids = symbols.tolist()
        if min(ids) >= 0 and max(ids) < len(self.pieces):
            return ids
        made: list[int] = []
        for s in ids:
            if 0 <= s < len(self.pieces):
                made.append(s)
                continue
            c = chr(-2 - s) if s < 0 else chr(int(np.flatnonzero(self.of_char == s)[0]))
            made += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]
        return made

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        units = [self.units(t) for t in texts]
        new = list(dict.fromkeys(u for us in units for u in us))
        ids = dict(zip(new, self.encode_units(new))) if new else {}
        return [[i for u in us for i in ids[u]] for us in units]

    def unit_text(self, ids: Sequence[int]) -> str:
        """Whole characters' ids as text, the space mark as a space."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def decode(self, ids: Sequence[int]) -> str:
        """Any list of ids; a run of byte pieces that is no UTF-8 gives U+FFFD for each odd byte."""
        out, run, first = [], b"", True

        def flush() -> None:
            nonlocal run
            while run:
                n = next((k for k in range(1, 5) if _valid(run[:k])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[n or 1 :]

        for i in ids:
            if i in self.byte_of:
                run += bytes([self.byte_of[i]])
                first = False
                continue
            flush()
            if self.kinds[i] == 2:
                out.append(" ⁇ ")
            elif self.kinds[i] != 3:
                p = self.pieces[i]
                if first and self.prefix and p.startswith(MARK):
                    p = p[1:]
                out.append(p.replace(MARK, " "))
            else:
                continue
            first = False
        flush()
        return "".join(out)


def _valid(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, Bpe] = {}


def model(model_file: str) -> Bpe:
    """The model, read once in each worker."""
    if model_file not in _models:
        _models[model_file] = Bpe(model_file)
    return _models[model_file]


class Cache:
    """Units' ids joined by commas.  A full generation becomes the old one, and its units that are met again move to the young one: frequent
    units stay, and rare ones don't fill a worker's memory.  Only texts that differ from their unit's are held."""

    def __init__(self) -> None:
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # decoded texts other than the unit with spaces for marks

    def fill(self, bpe: Bpe, units: set[str]) -> dict[str, str]:
        """The ids of all of units, and of some others, by unit."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
            self.odd = {u: t for u, t in self.odd.items() if u in self.old}
        lacking = units.difference(self.young)
        again = lacking.intersection(self.old)
        self.young.update((u, self.old[u]) for u in again)
        new = list(lacking - again)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for u, ids in zip(some, bpe.encode_units(some)):
                self.young[u] = ",".join(map(str, ids))
                text = bpe.unit_text(ids)
                if text != u.replace(MARK, " "):
                    self.odd[u] = text
        return self.young


def _encoded(texts: pa.Array, model_file: str, cache: Cache) -> Iterator[tuple[int, str, str]]:
    """For each text: number of ids, the ids joined by commas, the decoded text."""
    bpe = model(model_file)
    for at in range(0, len(texts), 256):
        units = [bpe.units(t.as_py() or "") for t in texts.slice(at, 256)]
        known = cache.fill(bpe, {u for us in units for u in us})
        for us in units:
            joined = ",".join([known[u] for u in us])
            text = "".join([cache.odd[u] if u in cache.odd else u.replace(MARK, " ") for u in us]) if cache.odd else "".join(us).replace(MARK, " ")
            yield joined.count(",") + 1 if us else 0, joined, text[1:] if bpe.prefix and text[:1] == " " else text


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, others: Sequence[str] = ()) -> DataFrame:
    """Encodes whole texts, without begin or end ids, and decodes the ids again.

    Returns id_col, `others`, n_tokens, ids_sha256 and decoded_sha256 (hex SHA-256 of the decimal ids joined by
    commas and of the decoded text), and with ids=True also ids (array<int>) and decoded.  A narrow map: no shuffle.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                n, a, d, lists, texts = [], [], [], [], []
                for k, joined, text in _encoded(part.column(1), model_file, cache):
                    n.append(k)
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    d.append(hashlib.sha256(text.encode()).hexdigest())
                    if ids:
                        lists.append([int(x) for x in joined.split(",")] if joined else [])
                        texts.append(text)
                cols = [part.column(0), *part.columns[2:], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                if ids:
                    cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])

    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join([f"_id {kind['_id']}", *[f"_o{i} {kind[f'_o{i}']}" for i in range(len(others))], "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    out = src.mapInArrow(kernels.tidy(run), schema + (", ids array<int>, decoded string" if ids else ""))
    return out.withColumnsRenamed({"_id": id_col, **{f"_o{i}": c for i, c in enumerate(others)}})
