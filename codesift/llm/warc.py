"""WARC archives of pages: one gzip member per record, written by tasks and read back record by record."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shipped
from .store import Workspace

shipped(__name__)

# production parameters
ARCHIVE_BYTES = 128 << 20  # an archive is closed once it has so many compressed bytes
LEAST_BYTES = 0  # equal payloads of at least so many bytes are written once
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
READ_BYTES = 1 << 16


def open_folder(folder: str):
    """File system and path of a folder given as a path or URI; tasks and driver see the same one."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One gzip member: header lines, an empty line, the block, two line ends."""
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}"]
    head += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    data = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode()
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, first: int | None, revisit: bool) -> bytes:
    """The record of a page; a revisit has the header of the answer only and names the page that has the payload."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    fields = {
        "WARC-Record-ID": f"<urn:uuid:{name}>", "Content-Type": "application/http; msgtype=response",
        # whatever a URL holds, the header line stays one line of ASCII
        "WARC-Target-URI": json.dumps(url)[1:-1] if url is not None else None,
        "WARC-Payload-Digest": f"sha1:{b32(digest)}", "X-Page": None if page_id is None else str(page_id),
        "X-Payload-Bytes": str(len(payload))}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        return record("response", fields, head + payload)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
               "WARC-Refers-To-Date": DATE, "X-Refers-To-Page": str(first)}
    return record("revisit", fields, head)


def write(pages: DataFrame, folder: str, work: Workspace, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> archive, records, bytes: the archives written below ``folder``.

    A null html is an empty payload.  Of pages with equal payloads the smallest page_id is the response; other
    ids revisit it; rows that repeat that id are responses themselves, and so is a payload whose pages all have
    no id.  The list of archives is a written table: what a lost or repeated task left behind is not in it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    rows = rows.join(again.select("digest", "first"), "digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
                         & (F.octet_length("payload") >= least_bytes), F.lit(False))
    rows = rows.select("page_id", "url", "payload", "digest", "first", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                page, url, payload, digest, first, seen = (batch.column(i)[r].as_py() for i in range(6))
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, many = system.open_output_stream(f"{root}/{name}"), 0, 0
                    size += out.write(record("warcinfo", {"Content-Type": "application/warc-fields"}, b"format: WARC/1.1\r\n"))
                size += out.write(page_record(page, url, payload, bytes.fromhex(digest), first, seen))
                many += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", many, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", many, size))
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.int64())], names=["archive", "records", "bytes"])

    return work.put(rows.mapInArrow(run, "archive string, records long, bytes long"), "archives")


class Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: BinaryIO, left: bytes):
        self.source, self.raw, self.data, self.unpacker = source, left, b"", zlib.decompressobj(31)

    def more(self) -> bytes:
        """Some further bytes; empty at the end of the member."""
        while not self.unpacker.eof:
            chunk = self.raw or self.source.read(READ_BYTES)
            if not chunk:
                raise ValueError("archive ends inside a record")
            data = self.unpacker.decompress(chunk, READ_BYTES * 4)
            self.raw = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if data:
                return data
        return b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not (data := self.more()):
                raise ValueError("record without an end of its header")
            self.data += data
        head, self.data = self.data[:at], self.data[at + len(mark):]
        return head

    def blocks(self, length: int) -> Iterator[bytes]:
        """Exactly ``length`` bytes, in pieces."""
        while length:
            data = self.data or self.more()
            if not data:
                raise ValueError("record shorter than its Content-Length")
            self.data = data[length:]
            data = data[:length]
            length -= len(data)
            yield data

    def close(self) -> bytes:
        """Checks the two line ends behind the block; returns the compressed bytes of the next member."""
        rest = self.data
        while data := self.more():
            rest += data
            if len(rest) > 4:
                break
        if rest != b"\r\n\r\n":
            raise ValueError("record does not end where its Content-Length says")
        return self.raw


def records(source: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order: fields, size and digests of what was read; the bytes only if asked for."""
    left = b""
    while True:
        left = left or source.read(READ_BYTES)
        if not left:
            return
        member = Member(source, left)
        lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block, payload, size, head, kept = hashlib.sha1(), hashlib.sha1(), 0, b"", []
        inside = not fields.get("Content-Type", "").startswith("application/http")
        for data in member.blocks(int(fields["Content-Length"])):
            block.update(data)
            if not inside:
                head += data
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                inside, data = True, head[at + 4:]
            payload.update(data)
            size += len(data)
            if payloads:
                kept.append(data)
        left = member.close()
        yield {"fields": fields, "size": size, "block": "sha1:" + b32(block.digest()), "payload": "sha1:" + b32(payload.digest()),
               "bytes": b"".join(kept) if payloads else None}


def read(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """archives(archive) -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, valid(, payload).

    valid says that the digests agree with what was read (of a revisit, that of its block).  A damaged archive
    raises an error.  Memory is one piece of a record, or one payload where payloads are asked for.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid", "payload"][:8 if payloads else 7]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                system, name = open_folder(path)
                out: list[tuple] = []
                held = 0
                with system.open_input_stream(name) as source:
                    for r in records(source, payloads):
                        f = r["fields"]
                        if f["WARC-Type"] not in ("response", "revisit"):
                            continue
                        number = {k: int(f[k]) if k in f else None for k in ("X-Page", "X-Refers-To-Page")}
                        url = json.loads(f'"{f["WARC-Target-URI"]}"') if "WARC-Target-URI" in f else None
                        whole = f["WARC-Type"] == "response"
                        good = r["block"] == f["WARC-Block-Digest"] and (not whole or r["payload"] == f["WARC-Payload-Digest"])
                        out.append((number["X-Page"], url, r["size"] if whole else int(f["X-Payload-Bytes"]),
                                    (r["payload"] if whole else f["WARC-Payload-Digest"]).removeprefix("sha1:"), f["WARC-Type"],
                                    number["X-Refers-To-Page"], good, r["bytes"] if whole else None)[:len(names)])
                        held += 200 + (r["size"] if payloads else 0)
                        if held > 8 << 20:
                            yield _batch(out, names, kinds)
                            out, held = [], 0
                yield _batch(out, names, kinds)

    # a task for each archive
    many = max(1, min(100_000, archives.count()))
    kinds_sql = ["long", "string", "long", "string", "string", "long", "boolean", "binary"]
    return archives.select("archive").repartition(many).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds_sql)))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
