"""WARC archives: one gzip member per record, read back by byte ranges.

Writing: records with equal payloads are grouped by digest; the one with the largest id is a
``response`` and the others are ``revisit`` records that refer to it. Reading is splittable
without an index: a task scans its byte range for the gzip magic, validates each candidate by
inflating it up to its WARC header, and then decodes the member to its end, past the end of the
range if need be. A record belongs to the task in whose range it starts.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path
from .files import create, open_at

MAGIC = b"\x1f\x8b\x08"
#: Bytes of one read task; a file is closed when it is larger than FILE_BYTES.
SPLIT_BYTES, FILE_BYTES = 32 << 20, 1 << 30
LEVEL, _READ = 6, 1 << 20
#: Payloads below this are not deduplicated.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:x-page:"
_SAFE = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}


def payload_digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header (with the payload's length) only."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or f'{_ID}{name}').translate(_SAFE)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without name or time, so that equal records give equal bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _writer(folder: str, file_bytes: int):
    names = ["uri", "bytes", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    if out is None:
                        (uri, out), size, n = create(folder, ".warc.gz"), 0, 0
                    data = member(warc_record(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to))
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([n])], names)
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([n])], names)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest: uri, bytes, records.

    Null html is an empty payload, a null url is the page's URN. Of equal payloads of at least
    ``min_bytes`` the row with the largest page_id is the response; rows that repeat this id are
    responses too, and where all ids are null every row is. Repeated rows are records of their
    own. An empty table gives an empty manifest.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    sha1 = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", sha1.alias("sha1"))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    # the digests are grouped without the payloads; these move once, and a hot digest's rows can be split
    keepers = rows.filter(size >= min_bytes).groupBy(F.col("sha1").alias("keeper_sha1")).agg(F.max("page_id").alias("keeper"))
    joined = rows.join(keepers, (F.col("sha1") == F.col("keeper_sha1")) & (size >= min_bytes), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.col("keeper").cast("string"))
    out = joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))
    return materialize(out.mapInArrow(_writer(folder, file_bytes), "uri string, bytes long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file from an offset on, read as needed and forgotten behind the reader."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start``."""
        if start < self.at or start + n > self.at + len(self.data):
            keep = self.data[start - self.at :] if self.at <= start < self.at + len(self.data) else b""
            want = min(self.size, start + max(n, _READ)) - start - len(keep)
            self.at, self.data = start, keep + (self.source.read_at(want, start + len(keep)) if want > 0 else b"")
        return self.data[start - self.at : start - self.at + n]


def _inflate(window: _Window, start: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``start`` if it is a whole WARC record, else None."""
    inflate, at, out, checked = zlib.decompressobj(31), start, [], False
    while not inflate.eof:
        data = window.get(at, 1 << 16)
        if not data:
            return None
        try:
            out.append(inflate.decompress(data))
        except zlib.error:
            return None
        at += len(data)
        if not checked and sum(map(len, out)) >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked = True
    content = b"".join(out)
    return (content, at - len(inflate.unused_data)) if content.startswith(b"WARC/1.") and b"\r\n\r\n" in content else None


def scan_range(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that start in [start, end) of an archive."""
    window, at = _Window(source, size), start
    while at < end:
        data = window.get(at, min(_READ, end - at + len(MAGIC) - 1))
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        record = _inflate(window, at)
        if record is None:
            at += 1
            continue
        yield at, record[0]
        at = record[1]


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload); header names in lower case."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(warc.get("content-length", len(rest)))]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_head.decode("utf-8", "replace").split("\r\n")[1:])}
    return warc, http, payload


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(_ID)
    return int(name) if name.lstrip("-").isdigit() else None


_READ_SCHEMA = "uri string, offset long, page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, digest_ok boolean, payload binary"


def _reader(with_payload: bool):
    names = [x.split()[0] for x in _READ_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_at(uri) as source:
                    rows, held = [], 0
                    for offset, record in scan_range(source, size, start, end):
                        warc, http, payload = parse(record)
                        kind, digest = warc.get("warc-type", ""), warc.get("warc-payload-digest", "").removeprefix("sha1:")
                        full = kind != "revisit"
                        n = len(payload) if full else int(http.get("content-length", 0))
                        rows.append((uri, offset, _page(warc.get("warc-record-id")), warc.get("warc-target-uri"), kind, digest, None if full else _page(warc.get("warc-refers-to")), n, payload_digest(payload) == digest if full else None, payload if with_payload and full else None))
                        held += len(payload) if with_payload else 1
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``files`` (uri, bytes), by byte ranges of ``split_bytes``.

    Damaged members are skipped, and the scan goes on behind them. ``digest_ok`` tells whether a
    response's payload has the digest of its header. Revisits have no payload; their
    ``payload_bytes`` is that of the page they stand for.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("uri", "bytes", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    spark = files.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, "uri", "start").mapInArrow(_reader(with_payload), _READ_SCHEMA)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(uri, bytes) of existing archives below ``path``, listed by Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(F.col("path").alias("uri"), F.col("length").alias("bytes"))


def warc_report(pages: DataFrame) -> DataFrame:
    """Per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; rows with the largest page_id of a payload are responses; an
    empty table gives an empty table; other columns are not looked at.
    """
    files = write_archives(pages)
    return read_archives(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INT >> 15) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INT >> 10) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INT >> 5) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * i + 1, 5))::INT & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p JOIN k USING (html)
"""
