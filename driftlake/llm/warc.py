"""WARC archives as a Spark data source, with revisit records for repeated payloads.

``spark.dataSource.register(WarcDataSource)`` gives format "warc".  Reading plans one partition for each run of
archive files; predicates on warc_type and on the header columns are pushed down, headers are parsed first, and the
payload of a record that fails them (or that option payload=false says nobody wants) is passed over without
being decoded.  Archives of our own have an index beside them, which holds every member's place and headers: there, unwanted
members aren't even read; in archives without one they are inflated to get past them.  Writing makes one archive for each task, a gzip member for each record, in a staging folder; the
committed tasks' files are then moved into place, so a lost executor's half-written archive never shows.

Files are reached through pyarrow.fs, so a path may be local or any store that it knows by URI.

Defined cases: a null payload is empty; records without an id column value get a record id made from their URL and
digest; a null URL has no WARC-Target-URI; an empty table writes no archive and reads back as no rows.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import json
import urllib.parse
import uuid
import zlib
from dataclasses import dataclass
from typing import BinaryIO, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from driftlake.llm.tables import shared_dir

SCHEMA = "record_id string, warc_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "warc-payload-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time; reruns give the same bytes
PLAN_BYTES = 64 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(record_id: str, warc_type: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record."""
    block = HTTP + (payload if warc_type == "response" else b"")
    head = [("WARC-Type", warc_type), ("WARC-Record-ID", record_id), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(uri, safe="%/:=&?~#+!$,;'@()*[]")))
    head += [("WARC-Payload-Digest", "sha1:" + digest), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(stream: BinaryIO, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records of an uncompressed stream: headers, and the block where wanted(headers) says 'block'; those for
    which it says None are passed over."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record: " + repr(line[:40]))
        headers: dict[str, str] = {}
        last = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[last := name.strip().lower()] = value.strip()
        length, want = int(headers["content-length"]), wanted(headers)
        if want == "block":
            yield headers, stream.read(length)
        else:
            stream.seek(length, io.SEEK_CUR)  # a gzip stream inflates it, but nothing is kept or decoded
            if want:
                yield headers, None


INDEX = ".idx"  # after an archive's name: for each member its offset, length and header lines


def member(stream: BinaryIO) -> tuple[dict[str, str], bytes]:
    """The only record of an inflated member."""
    return next(records(stream, lambda headers: "block"))


def indexed(at: fs.FileSystem, path: str, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As records(), for an archive with an index: headers come from the index, and only wanted members are read."""
    with at.open_input_stream(path + INDEX, compression=None) as f:
        entries = json.loads(zlib.decompress(f.read()))
    with at.open_input_file(path) as raw:
        for offset, length, headers in entries:
            want = wanted(headers)
            if want == "block":
                raw.seek(offset)
                yield headers, member(io.BytesIO(gzip.decompress(raw.read(length))))[1]
            elif want:
                yield headers, None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.equals: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) else ""
            if name in HEADERS and name != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equals[name] = self.equals.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Runs of archives of about PLAN_BYTES."""
        at, root = open_fs(self.path)
        found = at.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and "/_" not in f.path.removeprefix(root))
        plans: list[InputPartition] = []
        run: list[str] = []
        size = 0
        for path, n in files:
            if run and size + n > PLAN_BYTES:
                plans.append(Files(run))
                run, size = [], 0
            run.append(path)
            size += n
        return [*plans, Files(run)] if run else plans

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = pa.schema([*[(c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADERS], ("payload", pa.binary())])

        def wanted(headers: dict[str, str]) -> str | None:
            for name, values in self.equals.items():
                if headers.get(HEADERS[name]) not in values:
                    return None
            return "block" if self.payload and headers.get("warc-type") == "response" else "headers"

        at, _ = open_fs(self.path)
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with contextlib.ExitStack() as held:
                if at.get_file_info(path + INDEX).type == fs.FileType.File:
                    found = indexed(at, path, wanted)
                else:
                    raw = held.enter_context(at.open_input_stream(path, compression=None))
                    found = records(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BytesIO(raw.read()), wanted)
                for headers, block in found:
                    payload = None if block is None else payload_of(headers, block)
                    digest = headers.get("warc-payload-digest", "")
                    if payload is not None and digest.startswith("sha1:") and b32(hashlib.sha1(payload).digest()) != digest[5:]:
                        raise ValueError(f"{path}: payload of {headers.get('warc-record-id')} differs from its digest")
                    rows.append((*[int(headers[h]) if c == "payload_length" and h in headers else headers.get(h) for c, h in HEADERS.items()], payload))
                    size += len(payload or b"")
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Input columns: record_id, warc_type, target_uri, payload (binary), refers_to."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        at, root = open_fs(self.path)
        name, out, place, entries = None, None, 0, []
        try:
            for b in batches:
                for row in b.to_pylist():
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        at.create_dir(f"{root}/{self.staging}", recursive=True)
                        out = at.open_output_stream(f"{root}/{self.staging}/{name}", compression=None)
                    payload = row["payload"] or b""
                    digest = b32(hashlib.sha1(payload).digest())
                    rid = row["record_id"] or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (row['target_uri'] or '') + digest)}>"
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    whole = record(rid, row["warc_type"], row["target_uri"], payload, digest, row["refers_to"])
                    packed = packer.compress(whole) + packer.flush()
                    out.write(packed)
                    entries.append((place, len(packed), next(records(io.BytesIO(whole), lambda headers: "headers"))[0]))
                    place += len(packed)
        finally:
            if out is not None:
                out.close()
        if name is not None:
            with at.open_output_stream(f"{root}/{self.staging}/{name}{INDEX}", compression=None) as f:
                f.write(zlib.compress(json.dumps(entries).encode(), 4))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        at, root = open_fs(self.path)
        for m in messages:
            if m is not None and m.name:
                for end in (INDEX, ""):  # the archive last: what is there has its index
                    at.move(f"{root}/{self.staging}/{m.name}{end}", f"{root}/{m.name}{end}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        at, root = open_fs(self.path)
        if at.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/{self.staging}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The columns of WarcWriter: of rows with equal payloads of at least min_bytes the one with the smallest id is the
    response and the others are revisits that refer to it.  Rows that repeat that id are responses too."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    rows = rows.join(firsts, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    return rows.select(name(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), "target_uri", "payload", F.when(again, name(F.col("first"))).alias("refers_to"))


def archive(pages: DataFrame, path: str, **columns) -> None:
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").option("path", path).mode("append").save()


def round_trip(pages: DataFrame, id_col: str = "page_id", path: str | None = None, **columns) -> DataFrame:
    """Writes archives to the shared folder and reads them back: id_col, payload_bytes, payload_digest (bare), record_type,
    refers_to (an id), target_uri, payload (null for revisits)."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(pages, path, id_col=id_col, **columns)
    back = read_warc(spark, path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return back.select(
        number("record_id").alias(id_col),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
        "target_uri",
        "payload",
    )
