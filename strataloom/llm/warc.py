"""WARC archives: write records with an index, read selected records back.

Each task writes one archive (WARC/1.1, one gzip member a record) and yields an
index row per record: archive, offset, length, URL and digest. A reader takes
index rows, sorts them by archive and offset, joins ranges that lie close to
each other, and reads each joined range at once. A payload that was stored
before is written as a revisit record (profile identical-payload-digest); its
HTTP header still tells the full payload's length.

Archives lie in the session's shared folder and are reached through pyarrow's
file systems, so any store that those know will do. A task that is repeated
writes to a new name, and only names in the index are ever read.

Edge cases: a null html is an empty payload; a null url is written as
``about:blank`` and read back as such; of repeated rows that all hold the
largest key each is a response; rows of null key are responses; an empty table
gives an empty index; a payload of any size is one record; further columns are
unread.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import PREFIX, discard, hot_join, mapped, slices, store, work_dir

#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than this are read together, up to so many bytes at once.
GAP, SPAN = 1 << 16, 8 << 20
#: Index rows that one read task takes.
ROWS = 20_000

INDEX_DDL = "archive string, `offset` long, length long, page_id long, url string, digest string, record_type string"
READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def reached(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, with Hadoop's names of S3 among its schemes."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. ``digest``: hexadecimal SHA-1 of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-cased names), HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"fields": fields, "http": told, "payload": payload}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def digests(pages: DataFrame) -> DataFrame:
    """Stored rows ``(page_id, digest)`` of the pages that may be or have a revisit."""
    sized = pages.select("page_id", F.coalesce("html", F.lit("")).alias("h")).select(
        "page_id", F.unhex(F.sha1(F.encode("h", "UTF-8"))).alias("digest"), F.octet_length("h").alias("size")
    )
    return store(sized.filter((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")


def decisions(known: DataFrame) -> DataFrame:
    """Rows ``(page_id, digest, refers_to)`` of the pages that repeat a payload. Works
    on digests; a payload that any number of pages share is combined before
    the shuffle and joined back as one row, to several tasks if need be."""
    firsts = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return hot_join(known, firsts.filter("n > 1"), "digest", "page_id").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives of ``(page_id, url, html)`` and return their stored index."""
    folder = folder or f"{work_dir(pages.sparkSession)}/{PREFIX}warc-{uuid.uuid4().hex}"
    known = digests(pages)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("digest"))
    told = digested.join(decisions(known), ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in slices(batches):
            if out is None:
                system, path = reached(name)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)  # members are compressed already
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
                out.write(member)
                rows.append((name, at, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                at += len(member)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "length", "page_id", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    index = store(mapped(told.select("page_id", "url", "html", "refers_to"), run, INDEX_DDL), "warc-index")
    discard(known)
    return index


def joined(ranges: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """Sorted byte ranges ``(offset, length)`` joined to ``(start, end, their numbers)``."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, length) in enumerate(ranges):
        if out and at - out[-1][1] <= gap and at + length - out[-1][0] <= span:
            start, end, which = out[-1]
            which.append(i)
            out[-1] = (start, max(end, at + length), which)
        else:
            out.append((at, at + length, [i]))
    return out


def read(index: DataFrame, with_html: bool = False) -> DataFrame:
    """Records of the given index rows, read in joined byte ranges."""
    schema = READ_DDL + (", html string" if with_html else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            archives = batch.column(0).to_pylist()
            at, begin = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), 0
            while begin < len(archives):
                end = begin
                while end < len(archives) and archives[end] == archives[begin]:
                    end += 1
                system, path = reached(archives[begin])
                with system.open_input_file(path) as file:
                    for start, stop, which in joined(at[begin:end]):
                        data, rows = file.read_at(stop - start, start), []
                        for i in which:
                            offset, length = at[begin + i]
                            rows.append(_told(zlib.decompress(data[offset - start : offset - start + length], 31), with_html))
                        yield emit(rows)
                begin = end

    tasks = max(1, -(-index.count() // ROWS))
    if index.sparkSession.conf.get("spark.sql.shuffle.partitions"):
        tasks = max(tasks, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
    return mapped(dealt.sortWithinPartitions("archive", "offset"), run, schema)


def _told(data: bytes, with_html: bool) -> tuple:
    found = parse(data)
    fields, payload = found["fields"], found["payload"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    row = (_page(fields["warc-record-id"]), fields["warc-target-uri"], int(found["http"]["content-length"]), digest, kind, _page(fields.get("warc-refers-to")))
    return (*row, payload.decode() if kind == "response" else None) if with_html else row
