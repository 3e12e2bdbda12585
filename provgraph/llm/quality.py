"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, digits to 0, white space to single spaces, ends stripped)
and hashed. Per host (``source``) the distinct documents (ids) with each line are counted.
Lines above the limit are removed, and a document of which too little is left is rejected.

``copies_once`` counts whole copies of a text as one document, so that a text which was crawled
often does not turn into boilerplate as a whole. The pipeline sets it, as its next stage keeps
one document of each group of copies; without it that stage would find none of them left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A line is removed if more than this many distinct documents of its host have it, whatever the size of the host.
MAX_LINE_DOCS = 20
#: A document is depleted if fewer than this share of its words are left.
MIN_LEFT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the list, exactly."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    code, size, length = at, len(ids), 1
    while length < window:
        if size * len(ids) >= 1 << 62:  # renumber the runs seen so far, so that a code stays exact
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max()) + 1
        code = code[:-1] * len(ids) + at[length:]
        size, length = size * len(ids), length + 1
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none."""
    data = (text or "").encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, _SPACE))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), len(text or "") - spaces, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """Hash of each distinct normalised line with a word, and the words in all its repeats."""
    found: dict[int, int] = {}
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if words:
            key = line_hash(words)
            found[key] = found.get(key, 0) + len(words)
    return list(found), list(found.values())


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words).translate(_FOLD)) - (1 << 63)


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose hash is in ``gone``; lines without a word stay."""
    return "\n".join(x for x in text.split("\n") if not (words := x.encode().split()) or line_hash(words) not in gone)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "host", "text_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = part.column(2).to_pylist()
            stats = np.array([text_statistics(t) for t in texts], np.int64).reshape(-1, 5)
            lines = [line_hashes(t) for t in texts]
            text_ids = [hashlib.md5((t or "").encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text_ids, pa.binary()), *(pa.array(stats[:, i]) for i in range(5)), pa.array([a for a, _ in lines], pa.list_(pa.int64())), pa.array([b for _, b in lines], pa.list_(pa.int32()))], names
            )


_SCHEMA = "id long, host string, text_id binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, host, MD5 of the text, statistics, hashes of its lines."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("host"), "text").mapInArrow(_measure, _SCHEMA)


def _unit(copies_once: bool) -> Column:
    """What counts as one document: the text, or the id (a row without an id counts by its text)."""
    return F.hex("text_id") if copies_once else F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.hex("text_id"))


def shared_lines(rows: DataFrame, max_docs: int = MAX_LINE_DOCS, copies_once: bool = False) -> DataFrame:
    """(hit_host, hit_text, removed, gone) for each distinct text of a host with lines above the limit.

    ``removed`` counts the words in the lines that go, ``gone`` has their hashes. The distinct
    documents of a line are counted by (host, line, document) first, so that neither a host nor a
    line is gathered in one task.
    """
    lines = rows.select("host", _unit(copies_once).alias("unit"), F.explode("lines").alias("line"))
    common = lines.groupBy("host", "line").agg(F.count_distinct("unit").alias("docs")).filter(F.col("docs") > max_docs)
    common = materialize(common.select(F.col("host").alias("common_host"), F.col("line").alias("common_line")), "quality-common")
    each = _distinct_texts(rows).select("host", "text_id", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "text_id", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hit = each.join(common, each.host.eqNullSafe(common.common_host) & (each.line == common.common_line))
    return hit.groupBy(F.col("host").alias("hit_host"), F.col("text_id").alias("hit_text")).agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone"))


def _distinct_texts(rows: DataFrame) -> DataFrame:
    once = ["n_words", "n_repeat_words", "lines", "line_words"]
    return rows.groupBy("host", "text_id").agg(*[F.first(c).alias(c) for c in once])


def _verdict(rows: DataFrame, removed: DataFrame, min_left: float) -> DataFrame:
    out = rows.drop("lines", "line_words").join(removed, rows.host.eqNullSafe(removed.hit_host) & (rows.text_id == removed.hit_text), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return out.withColumn("base_failed", base_failed).withColumn("n_left", left).withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")))


def judge(docs: DataFrame, max_docs: int = MAX_LINE_DOCS, min_left: float = MIN_LEFT, copies_once: bool = False) -> DataFrame:
    """(doc_id, host, text_id, the statistics, base_failed, n_left, kept, gone) per row of ``docs``.

    ``n_left`` counts the words outside removed lines, ``gone`` has the hashes of these. A null
    host is a host of its own; null and empty texts have no words and fail the base rules. Rows
    of one id are one document, and repeated rows get equal verdicts; rows without an id count
    once per text. A tie with the limit stays. An empty table gives an empty table.
    """
    rows = materialize(measured(docs), "quality-rows")
    removed = shared_lines(rows, max_docs, copies_once)
    return _verdict(rows, removed, min_left).select(F.col("id").alias("doc_id"), "host", "text_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept", "gone")


def quality_filter(docs: DataFrame, strip: bool = True, max_docs: int = MAX_LINE_DOCS, min_left: float = MIN_LEFT, copies_once: bool = False) -> DataFrame:
    """The documents that the rules keep, without their removed lines unless ``strip`` is false.

    Columns are those of ``docs``, whatever they are called; repeated rows are kept or rejected
    together. Nulls and ties are as in ``judge``; an empty table gives an empty table.
    """
    measures = measured(docs)
    rows = materialize(_distinct_texts(measures) if copies_once else measures, "quality-texts")
    texts = rows if copies_once else _distinct_texts(rows)
    verdict = _verdict(texts, shared_lines(rows, max_docs, copies_once), min_left).filter("kept").select(F.col("host").alias("kept_host"), F.col("text_id").alias("kept_text"), "gone")
    rows = docs.select(F.struct("*").alias("doc"), "text", F.col("source").cast("string").alias("host"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"))
    kept = rows.join(verdict, rows.host.eqNullSafe(verdict.kept_host) & (rows.text_id == verdict.kept_text))
    if strip:
        cut = F.pandas_udf(lambda text, gone: pd.Series([t if g is None or t is None else without_lines(t, set(g.tolist())) for t, g in zip(text, gone, strict=True)], dtype=object), "string")
        kept = kept.withColumn("text", F.when(F.col("gone").isNotNull(), cut("text", "gone")).otherwise(F.col("text")))
    return kept.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def quality_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the statistics, base_failed, kept, and n_left; see ``judge`` for nulls, ties and repeats."""
    return judge(docs).drop("host", "text_id", "gone")


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, i, lines[i] AS line, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d))),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(w) > 0 GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c >= 2),
p AS (SELECT r, count(DISTINCT x) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS x FROM t) GROUP BY r),
b AS (SELECT d.r, doc_id, source, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN u ON d.r = u.r LEFT JOIN p ON d.r = p.r),
k AS (SELECT r, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS key, sum(len(w)) AS words
      FROM l WHERE len(w) > 0 GROUP BY r, key),
m AS (SELECT d.source, key FROM k JOIN d USING (r) GROUP BY d.source, key HAVING count(DISTINCT coalesce('i' || doc_id, text)) > 20),
x AS (SELECT k.r, sum(words) AS removed FROM k JOIN d USING (r) JOIN m ON m.source IS NOT DISTINCT FROM d.source AND m.key = k.key GROUP BY k.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left,
       NOT base_failed AND n_left >= 10 AND n_left >= 0.3 * n_words AS kept
FROM (SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (n_words - coalesce(removed, 0))::BIGINT AS n_left FROM b LEFT JOIN x USING (r))
"""
