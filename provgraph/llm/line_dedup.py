"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

Each document yields one row per distinct long line: hash, id, and the line's positions. Rows
are range-partitioned and sorted by hash and falling id, so the first row of a hash names the
document that keeps the line. A partition is streamed once: the rows of a hash after the first
are dropped as soon as enough documents have been seen. Only the first and last hash of a
partition may go on in a neighbour; their rows stay open, each partition adds two counts, and a
join over these counts (two rows per partition) settles them. So a line found in a third of all
documents spreads over many tasks, and no task holds more than a few rows at a time.

The result is a compressed bitmap of kept lines per document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_CHARS, MIN_DOCS = 40, 5
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _n_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def text_hash(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode()).digest()


def long_lines(text: str | None, min_chars: int = MIN_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the positions of each distinct key of at least ``min_chars`` code points."""
    lines = (text or "").encode().split(b"\n")
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars and _n_points(key) >= min_chars:
            found.setdefault(hashlib.md5(key).digest(), []).append(at)
    return len(lines), found


def _pack(at: list[int]) -> bytes:
    return np.array(at, "<u4").tobytes()


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(ids[k : k + 256], texts[k : k + 256].to_pylist(), strict=True):
                    n, found = long_lines(text, min_chars)
                    text_id = text_hash(text)
                    rows = [(None, b""), *((h, _pack(at)) for h, at in found.items())]
                    out[0] += [h for h, _ in rows]
                    out[1] += [doc_id] * len(rows)
                    out[2] += [text_id] * len(rows)
                    out[3] += [n] * len(rows)
                    out[4] += [at for _, at in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["hash", "doc_id", "text_id", "n_lines", "at"])

    return run


def _stream(min_docs: int):
    """Sorted rows (hash, doc_id falling with null last, text_id, at) of one partition -> decisions.

    kind 0: the line is dropped at these positions; 1: open, dropped if the hash has enough
    documents and another one keeps it; 2: the hash's documents here, with the largest id.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line = first = None
        n_docs, best, last_doc, held = 0, None, None, []
        out: list[tuple] = []

        def close(final: bool) -> None:
            if line is None:
                return
            if first or final:
                out.append((2, line, best, None, None, n_docs))
                out.extend((1, line, *row, None) for row in held)

        for frame in frames:
            for h, doc, none, text_id, at in zip(frame["hash"], frame["doc_id"], frame["no_id"], frame["text_id"], frame["at"], strict=True):
                doc = None if none else int(doc)
                if h != line:
                    close(False)
                    first, line = line is None, h
                    n_docs, best, last_doc, held = 1, doc, doc, []
                elif doc != last_doc:
                    n_docs, last_doc = n_docs + 1, doc
                row = (doc, text_id, at)
                if first:
                    out.append((1, h, *row, None))
                elif doc != best:
                    if n_docs < min_docs:
                        held.append(row)
                    else:
                        out.extend((0, None, *old, None) for old in [*held, row])
                        held = []
                if len(out) >= 8192:
                    yield _decisions(out)
                    out.clear()
        close(True)
        if out:
            yield _decisions(out)

    return run


def _decisions(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["kind", "hash", "doc_id", "text_id", "at", "n_docs"])
    return frame.assign(doc_id=frame["doc_id"].astype("Int64"), n_docs=frame["n_docs"].astype("Int64"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_id, n_lines, n_dropped, bitmap) per distinct document.

    ``bitmap`` is zlib over one bit per line (1: kept, first line in the highest bit). A line
    with a key of at least ``min_chars`` code points that is found in at least ``min_docs``
    distinct ids goes, except in the largest of these ids. Null and empty texts are one empty
    line. A null id is one more document, smaller than all others. Repeated rows share a bitmap.
    An empty table gives an empty table; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_line_rows(min_chars), "hash binary, doc_id long, text_id binary, n_lines long, at binary"), "line-rows")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = rows.filter("hash IS NOT NULL").select("hash", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text_id", "at")
    order = [F.col("hash"), F.col("no_id"), F.col("doc_id").desc()]
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = materialize(ranged.mapInPandas(_stream(min_docs), "kind int, hash binary, doc_id long, text_id binary, at binary, n_docs long"), "line-decisions")
    # at most two counts per partition: a broadcast of proven size
    ends = made.filter("kind = 2").groupBy("hash").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("best")).filter(F.col("docs") >= min_docs)
    opened = made.filter("kind = 1").select("hash", "doc_id", "text_id", "at").join(F.broadcast(ends), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("best")))
    gone = made.filter("kind = 0").select("doc_id", "text_id", "at").union(opened.select("doc_id", "text_id", "at"))
    per_doc = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text")).agg(F.collect_set("at").alias("at"))
    own = rows.filter("hash IS NULL").select("doc_id", "text_id", "n_lines").distinct()
    both = own.join(per_doc, own.doc_id.eqNullSafe(per_doc.gone_id) & (own.text_id == per_doc.gone_text), "left").select("doc_id", "text_id", "n_lines", "at")
    return both.mapInArrow(_bitmaps, "doc_id long, text_id binary, n_lines long, n_dropped long, bitmap binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_dropped, bitmaps = [], []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(at or []), "<u4")] = False
            n_dropped.append(n - int(keep.sum()))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_dropped, pa.int64()), pa.array(bitmaps, pa.binary())], ["doc_id", "text_id", "n_lines", "n_dropped", "bitmap"])


def kept_text(text: str | None, bitmap: bytes | None) -> str | None:
    """The lines that the bitmap keeps, joined by newlines; a text without a dropped line as it is."""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).astype(bool)
    return text if keep.all() else "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc, text, n_lines, n_dropped, bitmap) per row of ``docs``; ``doc`` holds its columns."""
    rows = docs.select(F.struct("*").alias("doc"), "text", F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("own_text"))
    same = rows.id.eqNullSafe(bitmaps.doc_id) & (rows.own_text == bitmaps.text_id)
    return rows.join(bitmaps, same).select("doc", "text", "n_lines", "n_dropped", "bitmap")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the bitmaps applied to ``text``; every document stays, if with an empty text.

    Columns are those of ``docs``, whatever they are called.
    """
    kept = F.pandas_udf(lambda text, bitmap: pd.Series([kept_text(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object), "string")
    out = _with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).withColumn("text", F.when(F.col("n_dropped") > 0, kept("text", "bitmap")).otherwise(F.col("text")))
    return out.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def line_dedup_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256.

    Nulls, ties and repeated rows are as in ``keep_bitmaps``; an empty table gives an empty table;
    other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    rows = _with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).select("doc.doc_id", "n_lines", "n_dropped", "text", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (kept_text(t, b) if d else t for t, b, d in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True))
            sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line,
             translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS best FROM l WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.best AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
