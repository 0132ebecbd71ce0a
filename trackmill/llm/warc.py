"""WARC archives: one gzip member a record, written and read by Spark tasks.

The reader goes through an archive front to back: it inflates each member piece by piece, takes the block by its
Content-Length, and checks the block and payload digests. No more than one record is held.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import committed_file, open_fs, shared_dir, utf8, written

READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
_ID = "urn:x-page:"


class BadRecord(ValueError):
    """A record that breaks the format."""


def _sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _clean(url: str | None) -> str:
    """A header value can't hold line ends."""
    return "urn:x-page:none" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _page_member(page_id, url, payload: bytes, first, date: str) -> bytes:
    """A page as a response, or as a revisit whose HTTP head tells the length that it leaves out."""
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_ID}{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _clean(url))]
    if url is None:
        head.append(("X-No-URI", "1"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{first}>")]
    head += [("WARC-Payload-Digest", f"sha1:{_sha(payload)}"), ("WARC-Block-Digest", f"sha1:{_sha(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(head, block)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, roll_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages as .warc.gz files below folder; returns the files (file, records, bytes).

    Among equal payloads of at least revisit_from bytes the smallest id is a response, the others revisit it. The
    smallest id comes from a grouped minimum (summed up before the shuffle), and the join back to the pages is a plain
    equi-join, whose hot keys adaptive execution splits. Null payloads are empty. Repeated rows of the smallest id are
    all responses; a page without an id is a revisit if its payload has an id, else a response. Columns other than the
    three named don't matter. A task that is run again replaces its files.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= revisit_from, F.sha1("payload")))
    firsts = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"))
    ready = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, made = TaskContext.get().partitionId(), 0, []
        members = (_page_member(*row, date) for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        member = next(members, None)
        while member is not None:
            name, n, size = f"part-{task:05d}-{k:04d}.warc.gz", 0, 0
            with committed_file(f"{folder}/{name}") as out:
                out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                while member is not None and size < roll_bytes:
                    out.write(member)
                    n, size, member = n + 1, size + len(member), next(members, None)
            made.append((f"{folder}/{name}", n, size))
            k += 1
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return written(ready.mapInArrow(write, "file string, records long, bytes long"), f"{folder}/files")


def read_records(stream, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open .warc.gz stream, front to back."""
    raw = b""
    while raw or (raw := stream.read(chunk)):
        unzip, head, body, need = zlib.decompressobj(31), None, bytearray(), -1
        while not unzip.eof:
            if not raw and not (raw := stream.read(chunk)):
                raise BadRecord("the archive ends within a record")
            body += unzip.decompress(raw, chunk)
            raw = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if head is None and (at := body.find(b"\r\n\r\n")) >= 0:
                lines = bytes(body[:at]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise BadRecord(f"not a record: {lines[0][:40]!r}")
                head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = int(head["content-length"])
                del body[: at + 4]
            if head is not None and len(body) > need + 4:
                raise BadRecord("a record is longer than its Content-Length")
        if head is None or len(body) != need + 4 or body[need:] != b"\r\n\r\n":
            raise BadRecord("a record doesn't have its Content-Length")
        yield head, bytes(body[:need])


def _number(text: str) -> int | None:
    value = text.strip("<>").removeprefix(_ID)
    return None if value == "None" else int(value)


def _row(head: dict[str, str], block: bytes, keep: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    told = head["warc-payload-digest"].removeprefix("sha1:")
    ok = head["warc-block-digest"].removeprefix("sha1:") == _sha(block)
    if head["warc-type"] == "revisit":
        size, digest, payload = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1]), told, None
    else:
        size, digest = len(payload), _sha(payload)
        ok = ok and digest == told
    refers = _number(head["warc-refers-to"]) if "warc-refers-to" in head else None
    url = None if "x-no-uri" in head else head["warc-target-uri"]
    return _number(head["warc-record-id"]), url, head["warc-type"], refers, size, digest, ok, payload if keep else None


def read_archives(files: DataFrame, *, file_col: str = "file", payloads: bool = True, batch_bytes: int = 1 << 22) -> DataFrame:
    """The page records of the archives named in files (one row a file): see READ.

    A task streams its files, so that memory doesn't grow with their size. A revisit gives the digest and length of the
    payload that it leaves out (its payload is null). digest_ok is false where a digest doesn't match; a record that
    breaks the framing raises BadRecord.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = open_fs(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in read_records(stream):
                        if head["warc-type"] in ("response", "revisit"):
                            rows.append(_row(head, block, payloads))
                            held += 300 + (len(block) if payloads else 0)
                            if held > batch_bytes:
                                yield pack(rows)
                                rows, held = [], 0
        yield pack(rows)

    return files.select(F.col(file_col).alias("file")).repartition(max(1, files.count())).mapInArrow(read, READ)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write_archives(pages, shared_dir(spark))
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER)) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_ok
FROM f
"""
