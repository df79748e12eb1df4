"""Documents in packed batches, so that a stage can look up in a distributed index and come back to its texts.

An index of all phrases or n-grams of a corpus has about as many entries as the corpus has words.  Rather than a row for
each, a task sums up what a batch of documents needs, and sends every shard of the index one compact sorted array
(map-side combining); the shard answers with an array in the same order.  The batch, which holds its
documents as compressed Arrow data, is shuffled once by its number, and meets the answers by that number.

Batches and shards both grow with the corpus, so their product must not be the number of messages.  A batch sends FAN messages at
most: beyond FAN shards, messages go in envelopes to groups of neighbouring shards, and a post office for each group and bundle of
batches sorts them into one message a shard; answers come back the same way.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm import kernels
from driftlake.llm.tables import parts

BATCH_BYTES = 4 << 20  # of text in a batch; a longer text is a batch of its own
SHARD_CHARS = 16 << 20  # of text for each shard of an index
FAN = 4096  # messages of a batch
BUNDLE = 1024  # batches whose envelopes meet in one post office

_squeeze = zstandard.ZstdCompressor(level=1)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays by bytes' place, so that small numbers compress to little; bytes go as they are."""
    out = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else _squeeze.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
        out.append(len(raw).to_bytes(8, "little") + raw)
    return b"".join(out)


def unpack(buffer, *kinds) -> list:
    view, at, out = memoryview(buffer), 0, []
    for kind in kinds:
        n = int.from_bytes(view[at : at + 8], "little")
        raw = view[at + 8 : at + 8 + n]
        at += 8 + n
        if kind is bytes:
            out.append(raw)
            continue
        flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel())
    return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit hash; it grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def runs(sorted_hashes: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of each shard that has some of the hashes."""
    of = shard_of(sorted_hashes, shards)
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return list(zip(of[head].tolist(), head.tolist(), [*head[1:].tolist(), len(of)]))


def packed(docs: DataFrame, id_col: str, text_col: str, others: Sequence[str] = ()) -> DataFrame:
    """(batch, payload): all rows' ids, texts and other columns (o0, o1, ...), dealt out by batch."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(others)])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=6)
        waiting: list[pa.RecordBatch] = []
        size = 0

        def one() -> pa.RecordBatch:
            nonlocal waiting, size, seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema) as w:
                for b in waiting:
                    w.write_batch(b)
            data = squeeze.compress(sink.getvalue())
            number = (part << 32) + seq
            waiting, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["batch", "payload"])

        for b in incoming:
            _, offsets = kernels.column(b.column(1))
            for i, j in kernels.spans(offsets, BATCH_BYTES):
                n = int(offsets[j] - offsets[i])
                if size and size + n > BATCH_BYTES:
                    yield one()
                waiting.append(b.slice(i, j - i))
                size += n
        if waiting:
            yield one()

    return src.mapInArrow(kernels.tidy(run), "batch long, payload binary").repartition(parts(docs.sparkSession), "batch")


def unpacked(payload) -> pa.Table:
    """The batch's rows, in order."""
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


def shards_for(docs: DataFrame, text_col: str) -> int:
    """How many shards an index over the texts has."""
    chars = docs.select(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-chars // SHARD_CHARS))


def _framed(items: list[tuple[int, bytes]]) -> bytes:
    """(number, message) pairs as one buffer."""
    head = np.array([len(items), *[x for n, m in items for x in (n, len(m))]], np.int64)
    return b"".join([head.tobytes(), *[m for _, m in items]])


def _unframed(buffer) -> list[tuple[int, memoryview]]:
    view = memoryview(buffer).cast("B")
    n = int(np.frombuffer(view[:8], np.int64)[0])
    head = np.frombuffer(view[8 : 8 + 16 * n], np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for number, size in head.tolist():
        out.append((number, view[at : at + size]))
        at += size
    return out


def _rows(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of numbers with a message at the end, as record batches of a few MB."""
    held: list[tuple] = []
    size = 0

    def one() -> pa.RecordBatch:
        cols = list(zip(*held))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.binary())], names=names)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 4 << 20 or len(held) >= 1024:
            yield one()
            held, size = [], 0
    if held:
        yield one()


def exchange(
    batches: DataFrame,
    shards: int,
    ask: Callable[[pa.Table], list[tuple[int, bytes]]],
    answer: Callable[[list[int], list], list[bytes]],
    finish: Callable[[int, pa.Table, list], pa.Table],
    schema: str,
) -> DataFrame:
    """For every batch: ask gives (shard, question) pairs; a shard's answer() gets the numbers of the batches that ask and their
    questions, and replies to all at once; finish gets the batch's number, its rows again and its replies in the order of
    shards, and returns rows of `schema`."""
    width = -(-shards // FAN)  # neighbouring shards of a group
    near = width == 1  # a group is a shard, and no post office is needed

    def questions(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in incoming:
                for number, payload in zip(b.column(0).to_pylist(), b.column(1)):
                    asked = ask(unpacked(payload.as_buffer()))
                    if near:
                        yield from ((shard, 0, number, q) for shard, q in asked)
                        continue
                    groups: dict[int, list[tuple[int, bytes]]] = {}
                    for shard, q in asked:
                        groups.setdefault(shard // width, []).append((shard, q))
                    yield from ((g, (number * 0x9E3779B97F4A7C15 >> 20) % bundles, number, _framed(some)) for g, some in groups.items())

        return _rows(rows(), ["place", "bundle", "batch", "message"])

    def sort_out(t: pa.Table) -> pa.Table:
        """Envelopes of a group's bundle, as a message for each shard that holds (batch, question) pairs."""
        place, bundle = t.column("place")[0].as_py(), t.column("bundle")[0].as_py()
        to: dict[int, list[tuple[int, bytes]]] = {}
        for number, m in zip(t.column("batch").to_pylist(), t.column("message")):
            for shard, q in _unframed(m.as_buffer()):
                to.setdefault(shard, []).append((number, q))
        return pa.table({"place": pa.array([place] * len(to), pa.int64()), "bundle": pa.array([bundle] * len(to), pa.int64()), "shard": pa.array(list(to), pa.int64()), "message": pa.array([_framed(x) for x in to.values()], pa.binary())})

    def replies(t: pa.Table) -> pa.Table:
        messages = [x.as_buffer() for x in t.column("message")]
        if near:
            got = answer(t.column("batch").to_pylist(), messages)
            kernels.give_back()
            return pa.table({"batch": t.column("batch"), "place": t.column("place"), "message": pa.array(got, pa.binary())})
        pairs = [_unframed(m) for m in messages]
        got = iter(answer([n for some in pairs for n, _ in some], [q for some in pairs for _, q in some]))
        kernels.give_back()
        back = [_framed([(n, next(got)) for n, _ in some]) for some in pairs]
        return pa.table({"place": t.column("place"), "bundle": t.column("bundle"), "shard": t.column("shard"), "message": pa.array(back, pa.binary())})

    def send_back(t: pa.Table) -> pa.Table:
        """The shards' messages of a group's bundle, as an envelope for each batch."""
        place = t.column("place")[0].as_py()
        to: dict[int, list[tuple[int, bytes]]] = {}
        for shard, m in zip(t.column("shard").to_pylist(), t.column("message")):
            for number, r in _unframed(m.as_buffer()):
                to.setdefault(number, []).append((shard, r))
        return pa.table({"batch": pa.array(list(to), pa.int64()), "place": pa.array([place] * len(to), pa.int64()), "message": pa.array([_framed(sorted(x, key=lambda y: y[0])) for x in to.values()], pa.binary())})

    def last(batch: pa.Table, reply: pa.Table) -> pa.Table:
        order = sorted(zip(reply.column("place").to_pylist(), range(reply.num_rows)))
        got = [reply.column("message")[i].as_buffer() for _, i in order]
        if not near:
            got = [r for m in got for _, r in _unframed(m)]
        done = finish(batch.column("batch")[0].as_py(), unpacked(batch.column("payload")[0].as_buffer()), got)
        kernels.give_back()
        return done

    bundles = 1 if near else max(1, -(-batches.count() // BUNDLE))
    asked = batches.mapInArrow(kernels.tidy(questions), "place long, bundle long, batch long, message binary")
    answered = "batch long, place long, message binary"
    if near:
        replied = asked.groupBy("place").applyInArrow(replies, answered)
    else:
        post = "place long, bundle long, shard long, message binary"
        replied = asked.groupBy("place", "bundle").applyInArrow(sort_out, post).groupBy("shard").applyInArrow(replies, post)
        replied = replied.groupBy("place", "bundle").applyInArrow(send_back, answered)
    return batches.groupBy("batch").cogroup(replied.groupBy("batch")).applyInArrow(last, schema)
