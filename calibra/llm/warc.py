"""WARC archives: one gzip member per record, written and read by tasks.

Records whose payload another record of smaller id has are revisits: they keep
the HTTP head (with the payload's length) and name the record they refer to.
The reader goes through a file from front to end: zlib unpacks piece by piece,
the members' ends split the records, Content-Length frames the block, and the
digests of block and payload are checked.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import col, materialise, release, scratch_path, slices, small_batches, table
from calibra.llm.sharedfs import open_fs, write_file

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Packed bytes after which a writer begins the next file; bytes read at once.
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 16


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _quoted(url: str) -> str:
    """A URL fit for a header line: control characters, blanks at the ends and
    the percent sign itself are written as %XX, so it can be read back."""
    out = "".join(c if c.isprintable() and c not in " %" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
                  for c in url)
    return out


def _unquoted(text: str) -> str:
    from urllib.parse import unquote_to_bytes

    return unquote_to_bytes(text).decode("utf-8", "surrogatepass")


def pack_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member.  ``refers_to``: the page whose payload this is."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes
    #: The payload's length: for a revisit, as its HTTP head says.
    payload_bytes: int = 0
    digest: str = field(default="")


class DamagedRecord(ValueError):
    """A record that breaks the framing or its digests."""


def _members(read, size: int = READ_BYTES) -> Iterator[Iterator[bytes]]:
    """The unpacked pieces of each gzip member."""
    data = read(size)
    while data:
        z = zlib.decompressobj(31)

        def pieces():
            nonlocal data
            while not z.eof:
                if not data and not (data := read(size)):
                    raise DamagedRecord("the file ends within a member")
                try:
                    out = z.decompress(data, size)
                except zlib.error as e:
                    raise DamagedRecord(str(e)) from e
                data = z.unused_data if z.eof else z.unconsumed_tail
                if out:
                    yield out

        yield pieces()
        if not z.eof:
            raise DamagedRecord("a member was not read to its end")
        data = data or read(size)


def read_records(read) -> Iterator[Record]:
    """The records of a file, given ``read(n)``.  Raises ``DamagedRecord``."""
    for member in _members(read):
        buffer = bytearray()
        for piece in member:
            buffer += piece
            if (end := buffer.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise DamagedRecord("a record without a head")
        lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise DamagedRecord(f"not a record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        length = int(headers["Content-Length"])
        body = buffer[end + 4:]
        for piece in member:
            body += piece
            if len(body) > length + 4:
                raise DamagedRecord("a block longer than Content-Length says")
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise DamagedRecord("a block other than Content-Length says")
        block = bytes(body[:length])
        if headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
            raise DamagedRecord("block digest")
        cut = block.index(b"\r\n\r\n") + 4
        http, payload = block[:cut], block[cut:]
        sizes = [int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] != "revisit" and (digest32(payload) != stated or sizes != [len(payload)]):
            raise DamagedRecord("payload digest")
        yield Record(headers, http, payload, sizes[0], stated)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to files in ``folder``; the manifest
    (``path``, ``n_records``, ``n_bytes``).

    Payloads are the UTF-8 of ``html`` (null: empty).  Among equal payloads of
    at least ``min_bytes`` bytes the smallest key's record is the response (all
    of them, if rows repeat that key), the others revisit it; a row without a
    key revisits, unless its payload has no key at all.  Other columns are not
    written.
    """
    src = pages.select(col(key).alias("page_id"), col(url).alias("url"),
                       F.encode(F.coalesce(col(html), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha1("payload")))
    # a row per payload found twice: keys and digests only, summed before they are shuffled
    first = (src.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("sha", "first"))
    # a hot payload's rows are split by the adaptive skew join
    marked = src.join(first, "sha", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
        F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        part = seq = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            path = f"{folder}/part-{part:06d}-{seq:05d}.warc.gz"
            row = [{"path": path, "n_records": len(held), "n_bytes": write_file(path, held)}]
            held.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_pylist(row, schema)

        schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                part = piece.column(4)[0].as_py()
                for row in zip(*(c.to_pylist() for c in piece.columns[:4]), strict=True):
                    held.append(pack_record(*row))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield flush()
        if held:
            yield flush()
        release()

    small_batches(pages.sparkSession)
    return marked.mapInArrow(write, "path string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of a manifest's files: ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, and
    ``payload`` if asked for (null in revisits)."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = open_fs(path)
                rows, size = [], 0
                with fs.open_input_stream(p, compression=None) as f:
                    for r in read_records(f.read):
                        h = r.headers
                        key, refers, target = (h.get(x) for x in ("X-Page-ID", "X-Refers-To-Page-ID", "WARC-Target-URI"))
                        row = {"page_id": key and int(key), "url": None if target is None else _unquoted(target),
                               "payload_bytes": r.payload_bytes, "payload_digest": r.digest,
                               "record_type": h["WARC-Type"], "refers_to": refers and int(refers)}
                        if payloads:
                            row["payload"] = None if row["record_type"] == "revisit" else r.payload
                        rows.append(row)
                        size += len(r.payload) * payloads
                        if len(rows) >= 10_000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(manifest.count(), 100_000))
    ddl = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
           + ", payload binary" * payloads)
    return manifest.select("path").repartitionByRange(tasks, "path").mapInArrow(read, ddl)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write ``pages`` as archives and read them back.  An empty table gives
    no file and no row."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = materialise(write_archives(pages, folder, min_bytes=min_bytes), "manifest")
    return read_archives(manifest, payloads)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``pages`` as read back from the archives."""
    return archive(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
bits AS (SELECT page_id, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32, 1) FOR i IN range(32)],
    'string_agg', '') AS d FROM p)
SELECT p.page_id, url, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN p.page_id = min(p.page_id) OVER (PARTITION BY b) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> min(p.page_id) OVER (PARTITION BY b) THEN min(p.page_id) OVER (PARTITION BY b) END AS refers_to
FROM p JOIN bits ON bits.page_id = p.page_id
"""
