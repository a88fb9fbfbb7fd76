"""Web archives: a writer of records with revisits, and a sequential reader.

An archive is a run of gzip members, one for each record.  The reader takes the
file in blocks, inflates member after member with an incremental decompressor,
frames a record by its Content-Length and verifies its digests; it holds one
record and one block, whatever the archive's length.  Archives lie in the folder
that all executors share.  A writing task makes files under names of its own and
reports them in a manifest; only files in the manifest count, so what a lost or
repeated task leaves behind is never read.

Records with equal payloads of at least `MIN_REVISIT` bytes are told apart by digest
and length: the one with the largest id is the response, the others are revisits
that carry the HTTP head only and refer to it.

Cases: a null payload is an empty one, a null URL is left out, line breaks in a URL
are percent-encoded; rows that repeat id and payload of a response are responses
too; if all ids of equal payloads are null, all are responses; an empty table
writes no archive and reads no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import join_on, new_folder, register, save, table

MIN_REVISIT = 1000
#: a file is closed once it is this long
ARCHIVE_BYTES = 256 << 20
BLOCK = 1 << 18
#: the date that records without one of their own carry
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4


def _id(page) -> str:
    return f"<urn:fieldrecon:page:{'' if page is None else page}>"


def _page(uri: str | None):
    value = uri.removeprefix("<urn:fieldrecon:page:").removesuffix(">") if uri else ""
    return int(value) if value else None


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page, url: str | None, payload: bytes, length: int, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member.  `length` and hex `digest` are those of the full payload, which a revisit leaves out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Adds _payload (binary), _length, _digest (hex) and _refers_to (null for responses)."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.withColumn("_payload", body).withColumn("_length", F.octet_length("_payload").cast("long")).withColumn("_digest", F.sha1("_payload"))
    narrow = save(rows.filter(F.col("_length") >= min_bytes).select(F.col(page_id).alias("_page"), "_digest", "_length"), "digests")
    top = narrow.groupBy("_digest", "_length").agg(F.max("_page").alias("_refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = narrow.join(top, ["_digest", "_length"]).filter((F.col("_page") < F.col("_refers_to")) | F.col("_page").isNull() & F.col("_refers_to").isNotNull())
    again = save(again.select("_page", "_digest", "_refers_to").distinct(), "revisits")
    rows = rows.withColumn("_page", F.col(page_id))
    return join_on(rows, again, ["_page", "_digest"], "left").drop("_page")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes one record for each row into archives below `folder`; returns the manifest: path, records, bytes."""
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    rows = with_revisits(rows, "page", "payload")
    rows = rows.select("page", "url", "_payload", "_length", "_digest", F.col("_refers_to").cast("long").alias("refers"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, path, records, size = None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for at in range(0, b.num_rows, 200):
                for r in b.slice(at, 200).to_pylist():
                    if out is None:
                        path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)  # the members are compressed already
                    member = record(r["page"], r["url"], r["_payload"], r["_length"], r["_digest"], r["refers"], r["refers"] is not None)
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return save(rows.mapInArrow(store, "path string, records long, bytes long"), "manifest")


class Inflate:
    """Reads the members of a gzip file one after another, without ever holding more than was asked for and a block."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.rest, self.out, self.engine = raw, b"", bytearray(), None

    def next_member(self) -> bool:
        """Goes to the next member, if there is one."""
        if not self.rest:
            self.rest = self.raw.read(BLOCK)
        self.engine, self.out = (zlib.decompressobj(31) if self.rest else None), bytearray()
        return self.engine is not None

    def _more(self) -> bool:
        if self.engine.eof:
            return False
        data = self.rest or self.raw.read(BLOCK)
        if not data:
            raise ValueError("the archive ends inside a record")
        self.out += self.engine.decompress(data, BLOCK)
        self.rest = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before `mark`, which is skipped."""
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if not self._more():
                raise ValueError("a record has no complete head")
        got = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def finish(self) -> bytes:
        """What the member still holds: at most a few bytes, or the record is framed wrongly."""
        while len(self.out) <= 4 and self._more():
            pass
        return bytes(self.out)


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in fields}


def _verify(claim: str | None, data: bytes, what: str, record_id: str | None) -> None:
    if claim is not None and claim != _sha1(data):
        raise ValueError(f"{what} digest of {record_id} does not match")


def records(raw: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of every record; raises ValueError where framing or a digest is wrong."""
    members = Inflate(raw)
    while members.next_member():
        version, head = _headers(members.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]}")
        block = members.take(int(head["content-length"]))
        if members.finish() != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} is longer than its Content-Length")
        _verify(head.get("warc-block-digest"), block, "block", head.get("warc-record-id"))
        http, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = _headers(top)[1]
        if head.get("warc-type") == "response":
            _verify(head.get("warc-payload-digest"), payload, "payload", head.get("warc-record-id"))
        yield head, http, payload


READ = "page long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in `manifest` (path): page, url, type, refers_to, length and digest of the full payload, payload."""
    kinds = READ if with_payload else READ.removesuffix(", payload binary")
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    files = manifest.count()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for path in b["path"].to_pylist():
                where, inside = fs.FileSystem.from_uri(path)
                with where.open_input_stream(inside, compression=None) as raw:
                    for head, http, payload in records(raw):
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = int(http.get("content-length", len(payload)))
                        row = (_page(head.get("warc-record-id")), head.get("warc-target-uri"), head["warc-type"], _page(head.get("warc-refers-to")), length, digest)
                        held.append((*row, payload) if with_payload else row)
                        size += len(payload) * with_payload + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=False)], names)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=False)], names)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(load, kinds)


TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def check_revisits(found: DataFrame) -> DataFrame:
    """Revisits whose response is missing or has another digest: empty for sound archives."""
    revisits = found.filter("record_type = 'revisit'").select("page", F.col("refers_to").alias("to"), F.col("payload_digest").alias("digest"))
    responses = found.filter("record_type = 'response'").select(F.col("page").alias("to"), F.col("payload_digest").alias("digest")).distinct()
    return join_on(revisits, responses, ["to", "digest"], "left_anti")


@register(
    "op1_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    top AS (SELECT body, max(page_id) AS id FROM p WHERE strlen(body) >= 1000 GROUP BY body)
    SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
        CASE WHEN id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN id <> page_id THEN id END AS refers_to
    FROM p LEFT JOIN top USING (body)
    """,
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    found = read(manifest, with_payload=False)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
