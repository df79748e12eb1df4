"""Token ids in binary files: documents in order of their ids, packed by Simple-8b.

``spark.dataSource.register(TokenFiles)`` gives format "token_ids".  Texts are dealt out by ranges of document ids, so that each task
writes the next stretch of the whole sequence to a file of its own; committing the job moves the files into place and writes a
manifest, in which each file has the number of ids before it.  A file holds

    MAGIC, little-endian 64-bit words of all blocks, words of each block (16 bits each; their sums are the blocks' offsets),
    documents (Arrow stream: doc_id, n_tokens), a tail of numbers.

A reader plans a task for each file; within it some blocks are decoded at a time.

The tokenizers library encodes the pieces of words between white space, each once, and workers remember them: this tokenizer drops
white space, looks at nothing beyond it, and never joins letters with punctuation after them.  Tests compare this with whole texts.

Defined cases: a null or empty text has the end id alone; documents without an id come first; rows that repeat an id stand in the order
of their texts' hashes; an empty table writes a manifest without files and reads back as no rows.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from driftlake.llm import kernels, simple8b
from driftlake.llm.tables import new_path, parts
from driftlake.llm.warc import open_fs

MAGIC = b"TOKIDS01"
MANIFEST = "_manifest.json"
END = 2  # the id after each document
TEXT_BYTES = 8 << 20  # of text that is encoded at a time
FILE_CHARS = 256 << 20  # of text for a file
CHUNK = 512 * simple8b.BLOCK  # ids that are packed or unpacked at a time
REMEMBERED = 1_000_000  # pieces of words; a worker then starts anew, so memory is bounded
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # each has one lower-case letter, and none joins another into a third
TRAILING = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe: after letters it is a piece of its own
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"

_TAIL = struct.Struct("<4Q8s")  # ids, documents, bytes of words, bytes of the documents' stream, MAGIC


class Encoder:
    """Texts to ids, by the library's encoding of each distinct piece of their words.

    A piece is a run of letters of Latin 1 in lower case, the ASCII punctuation after it, or else a whole word.  Letters need neither the
    normaliser nor the splitting of the tokenizer, so they go to it as words that are already split."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole, self.plain = Tokenizer.from_file(tokenizer_file), Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer, self.plain.pre_tokenizer = None, ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.plain.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith(self.plain.model.end_of_word_suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""], pa.large_string())  # pieces, and where each one's ids are:
        self.begin, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, some: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, some])
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))

    def places(self, found: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is known."""
        at = pc.index_in(found, value_set=self.known)
        if len(self.known) + at.null_count > REMEMBERED:
            self.forget()
            at = pc.index_in(found, value_set=self.known)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        letters = np.asarray(pc.match_substring_regex(found.take(pa.array(new)), "^[a-zß-öø-ÿ]+$"))
        for where, learn in ((new[letters], self._learn_plain), (new[~letters], self._learn_whole)):
            if len(where):
                some = found.take(pa.array(where))
                place[where] = len(self.known) + np.arange(len(where))
                self._add(some, *learn(some.to_pylist()))
        return place

    def _learn_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(runs, is_pretokenized=True, add_special_tokens=False)])
        return np.diff(np.flatnonzero(self.closes[ids]), prepend=-1), ids

    def _learn_whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, END after each; how many each has)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        first = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        cut = pc.extract_regex(words, f"^(?P<letters>[{LETTERS}]+)(?P<after>[{TRAILING}]*)$")
        halves = [pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "letters")), words), pc.fill_null(pc.struct_field(cut, "after"), "")]
        at = np.empty((len(words), 2), np.int64)
        both = pa.concat_arrays(halves).dictionary_encode()
        at[:] = self.places(both.dictionary)[np.asarray(both.indices)].reshape(2, -1).T
        at = at[np.asarray(coded.indices)].ravel()  # two pieces a word
        many = self.size[at]
        before = np.concatenate(([0], np.cumsum(many)))
        ids = self.ids[np.repeat(self.begin[at] - before[:-1], many) + np.arange(before[-1])]
        ends = before[2 * (first - first[0])]
        return np.insert(ids, ends[1:], np.uint32(END)), np.diff(ends) + 1


@functools.lru_cache(1)
def encoder(tokenizer_file: str) -> Encoder:
    """The worker's own, which outlives a task."""
    return Encoder(tokenizer_file)


@dataclass
class Written(WriterCommitMessage):
    number: int
    name: str | None
    n_ids: int
    n_docs: int


class TokenWriter(DataSourceArrowWriter):
    """Input columns: doc_id, text.  Partitions follow each other as their numbers do."""

    def __init__(self, options: dict[str, str]):
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        at, root = open_fs(self.path)
        mine = encoder(self.tokenizer)
        number, name, out = TaskContext.get().partitionId(), None, None
        docs: list[pa.RecordBatch] = []
        sizes: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        held = n_ids = n_bytes = 0

        def flush(last: bool) -> None:
            nonlocal waiting, held, n_bytes
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            cut = len(ids) if last else len(ids) // simple8b.BLOCK * simple8b.BLOCK
            for i in range(0, cut, CHUNK):
                words, per_block = simple8b.encode(ids[i : min(i + CHUNK, cut)])
                out.write(words.astype("<u8").tobytes())
                sizes.append(per_block.astype("<u2"))
                n_bytes += 8 * len(words)
            waiting, held = [ids[cut:]], len(ids) - cut

        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if out is None:
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.ids"
                    at.create_dir(f"{root}/{self.staging}", recursive=True)
                    out = at.open_output_stream(f"{root}/{self.staging}/{name}", compression=None)
                    out.write(MAGIC)
                _, offsets = kernels.column(b.column(1))
                for i, j in kernels.spans(offsets, TEXT_BYTES):
                    ids, n = mine.encode(b.column(1).slice(i, j - i))
                    n_ids += len(ids)
                    waiting.append(ids)
                    held += len(ids)
                    docs.append(pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n)], names=["doc_id", "n_tokens"]))
                    if held >= CHUNK:
                        flush(False)
            if out is not None:
                flush(True)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    for d in docs:
                        w.write_batch(d)
                stream = sink.getvalue()
                out.write(np.concatenate(sizes).tobytes())
                out.write(stream)
                out.write(_TAIL.pack(n_ids, sum(d.num_rows for d in docs), n_bytes, stream.size, MAGIC))
        finally:
            if out is not None:
                out.close()
        return Written(number, name, n_ids, sum(d.num_rows for d in docs))

    def commit(self, messages: list[Written | None]) -> None:
        at, root = open_fs(self.path)
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.number):
            at.move(f"{root}/{self.staging}/{m.name}", f"{root}/{m.name}")
            files.append({"name": m.name, "start": before, "n_ids": m.n_ids, "n_docs": m.n_docs})
            before += m.n_ids
        at.create_dir(root, recursive=True)
        with at.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:  # last: what it lists is there
            f.write(json.dumps(files).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        at, root = open_fs(self.path)
        if at.get_file_info(f"{root}/{self.staging}").type.name == "Directory":
            at.delete_dir(f"{root}/{self.staging}")


@dataclass
class OneFile(InputPartition):
    name: str
    start: int


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        at, root = open_fs(self.path)
        with at.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            return [OneFile(x["name"], x["start"]) for x in json.loads(f.read())]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        at, root = open_fs(self.path)
        with at.open_input_file(f"{root}/{partition.name}") as f:
            f.seek(f.size() - _TAIL.size)
            n_ids, n_docs, n_bytes, n_stream, magic = _TAIL.unpack(f.read(_TAIL.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.name}: not a file of token ids")
            f.seek(len(MAGIC) + n_bytes)
            blocks = -(-n_ids // simple8b.BLOCK)
            per_block = np.frombuffer(f.read(2 * blocks), "<u2").astype(np.int64)
            docs = pa.ipc.open_stream(f.read(n_stream)).read_all()
            offsets = np.concatenate(([0], np.cumsum(per_block)))
            number, size = docs.column(0).combine_chunks(), docs.column(1).to_numpy()
            ends = np.cumsum(size)
            rest, doc, seen = np.zeros(0, np.uint32), 0, 0
            f.seek(len(MAGIC))
            for b in range(0, blocks, CHUNK // simple8b.BLOCK):
                e = min(b + CHUNK // simple8b.BLOCK, blocks)
                words = np.frombuffer(f.read(8 * int(offsets[e] - offsets[b])), "<u8")
                ids = simple8b.decode(words, per_block[b:e], min(e * simple8b.BLOCK, n_ids) - b * simple8b.BLOCK).astype("<u4")
                seen += len(ids)
                rest = np.concatenate((rest, ids))
                until = int(np.searchsorted(ends, seen, "right"))  # documents that are whole by now
                if until > doc:
                    n = size[doc:until]
                    cut = np.concatenate(([0], np.cumsum(4 * n)))
                    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), until - doc, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(rest[: cut[-1] // 4].tobytes())])
                    yield pa.RecordBatch.from_arrays([number.slice(doc, until - doc), pa.array(partition.start + ends[doc:until] - n), pa.array(n), raw.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    rest, doc = rest[cut[-1] // 4 :], until


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


def write(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids, in ascending order of id_col."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.select(F.sum(F.length("text").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(parts(spark), -(-chars // FILE_CHARS)), *order).sortWithinPartitions(*order)
    dealt.write.format("token_ids").option("path", path).option("tokenizer", tokenizer_file).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids), ids as little-endian 32-bit integers."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_ids").option("path", path).load()


def round_trip(docs: DataFrame, tokenizer_file: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files and reads them back: id_col, start, n_tokens, ids_crc32, ids."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    write(docs, path, tokenizer_file, id_col, text_col)
    return read(spark, path).select(F.col("doc_id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
