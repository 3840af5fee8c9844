"""Deterministic sharded WARC writing and reading.

``write_archives`` sorts records by page into id ranges, writes each range as gzip-per-record files that roll at a
compressed size, and regenerates every header and digest from the rows. Of records with equal payloads of at
least ``least_bytes``, the one with the largest id is the response and the others revisit it. Files are written
under a temporary name, renamed, and named in a manifest; only files of the manifest are read, and a repeated task
writes the same bytes again.

Defined cases: a null html is an empty payload; a null url is written as an empty target; a null id is written
as an empty header and sorts first; rows that share an id are all written, and with equal payloads all are
responses; line breaks in a url are percent-encoded; an empty table writes no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import attach_groups, id_bounds, id_bucket, materialize, new_path, shuffle_parts, small_batches

LEAST_BYTES = 1000
ROLL_BYTES = 16 << 20
PIECE = 1 << 15
#: Written into every record, so that a second run gives the same files.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None) -> bytes:
    """One gzip member: WARC headers, HTTP headers, and the payload unless the record is a revisit."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    key = hashlib.sha256(f"{page}\n{url}\n{sha1}\n{refers}".encode()).digest()[:16]
    head = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=key, version=5)}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Page-ID": "" if page is None else str(page),
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Page-ID": str(refers)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def members(data: bytes) -> Iterator[bytes]:
    """The contents of each gzip member; input goes in by pieces, so that a member's end is found without copying
    what follows it."""
    at = 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            piece = data[at : at + PIECE]
            if not piece:
                raise ValueError("the last gzip member is cut off")
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one to a member; the lengths and block digests are checked."""
    for record in members(data):
        lines, _, rest = record.partition(b"\r\n\r\n")
        lines = lines.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(head["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or head["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"broken record {head['WARC-Record-ID']}")
        yield head, block


class _Roll:
    """One open archive under its temporary name."""

    def __init__(self, root: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        self.name, self.path, self.temporary = name, f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex}"
        self.out, self.records, self.bytes, self.sha1 = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha1()

    def add(self, record: bytes) -> None:
        self.out.write(record)
        self.sha1.update(record)
        self.records, self.bytes = self.records + 1, self.bytes + len(record)

    def commit(self) -> pa.RecordBatch:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return pa.RecordBatch.from_pylist([{"name": self.name, "records": self.records, "bytes": self.bytes, "sha1": self.sha1.hexdigest()}])


def _write(batches: Iterator[pa.RecordBatch], root: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id, url, html, sha1, refers) in order -> one row per file. A row with refers only tells that
    the pages of its id and digest, which follow it, revisit that page."""
    bucket, seq, roll = None, 0, None
    at, told = None, {}
    for batch in batches:
        for b, page, url, html, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if page != at:
                at, told = page, {}
            if refers is not None:
                told[sha1] = refers
                continue
            if roll and (b != bucket or roll.bytes >= roll_bytes):
                yield roll.commit()
                roll = None
            if b != bucket:
                bucket, seq = b, 0
            if roll is None:
                roll = _Roll(root, f"pages-{b:06d}-{seq:06d}.warc.gz")
                seq += 1
            roll.add(_record(page, url, (html or "").encode(), sha1, told.get(sha1)))
    if roll:
        yield roll.commit()


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives under root and returns their manifest: name, records, bytes, sha1."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("n"))
    digests = materialize(rows.select("id", "sha1", "n").filter(f"n >= {least_bytes}"), "warc-digests")
    groups = materialize(digests.groupBy("sha1").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "warc-groups")
    revisits = attach_groups(digests.select("id", "sha1"), groups, "sha1", "size", digests.count()).filter("not id <=> keep").select("id", "sha1", F.col("keep").alias("refers")).distinct()
    bounds = id_bounds(pages, id_col, shuffle_parts(pages.sparkSession))
    # what revisits what travels beside the pages to their buckets: the payloads are shuffled once
    none = F.lit(None).cast("string")
    rows = rows.select("id", "url", "html", "sha1", F.lit(None).cast("long").alias("refers")).unionByName(revisits.select("id", none.alias("url"), none.alias("html"), "sha1", "refers"))
    rows = rows.withColumn("bucket", id_bucket(F.col("id"), bounds).cast("long"))
    rows = rows.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), F.col("refers").asc_nulls_last(), "sha1", "url")
    job = partial(_write, root=root, roll_bytes=roll_bytes)
    return materialize(small_batches(rows.select("bucket", "id", "url", "html", "sha1", "refers")).mapInArrow(job, "name string, records long, bytes long, sha1 string"), "warc-manifest")


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(root)
    for batch in batches:
        for name, sha1 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                data = f.read()
            if hashlib.sha1(data).hexdigest() != sha1:
                raise ValueError(f"{name} is not the file of the manifest")
            rows = []
            for head, block in parse_records(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = head["WARC-Type"] == "revisit"
                size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
                digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex() if revisit else hashlib.sha1(payload).hexdigest()
                rows.append((int(head["WARC-Page-ID"]) if head["WARC-Page-ID"] else None, head["WARC-Target-URI"], size, digest, head["WARC-Type"], int(head["WARC-Refers-To-Page-ID"]) if revisit else None, None if revisit else payload.decode()))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])


def read_archives(spark: SparkSession, manifest: DataFrame, root: str, id_col: str = "page_id") -> DataFrame:
    """One row per record of the manifest's files: id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits)."""
    files = manifest.select("name", "sha1").repartition(shuffle_parts(spark), "name")
    return files.mapInArrow(partial(_read, root=root), "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string").withColumnRenamed("id", id_col)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    root = new_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, root), root).drop("html")
