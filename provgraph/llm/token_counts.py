"""Token counts from flat token files without an index.

A token file is a run of little-endian unsigned 16-bit ids; each document ends with one
end-of-document id. Blocks of the files are searched for that id with vector operations, each on
its own; a block reports how many separators it has, the tokens before its first, and where its
last one is. A prefix scan over the blocks of each file (a window over one row per block) then
gives every block the number of documents before it and the tokens of the document that is open
where it starts, and the lengths of the documents that end in it follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tok
from .common import materialize, scratch_path
from .files import create, open_at

#: Tokens of a block; a file closes when it has so many tokens or documents.
BLOCK_TOKENS, FILE_TOKENS, FILE_DOCS = 1 << 20, 1 << 28, 1 << 18
_TYPE = np.dtype("<u2")


def _writer(vocabulary, folder: str, file_tokens: int):
    names = ["uri", "n_tokens", "ordinal", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = vocabulary.value
        if tokenizer.n >= 1 << 16:
            raise ValueError("16-bit token files need fewer than 65,536 ids")
        out, ids = None, []

        def close() -> pa.RecordBatch:
            out.close()
            k = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([uri] * k), pa.array([size] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array(ids, pa.int64())], names)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if out is None:
                        (uri, out), size, ids = create(folder, ".tok"), 0, []
                    found = np.array([*tokenizer.encode(text or ""), tokenizer.n], _TYPE)
                    out.write(found.tobytes())
                    size += len(found)
                    ids.append(doc_id)
                    if size >= file_tokens or len(ids) >= FILE_DOCS:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return run


def write_token_files(docs: DataFrame, vocabulary: str = tok.VOCABULARY, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the texts of ``docs`` as token files; (uri, n_tokens, ordinal, doc_id) per document.

    Null and empty texts are documents of no token. The rows are the manifest and tell which
    document is which; the scan needs only the files' names and sizes.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_writer(tok.load(spark, vocabulary), folder, file_tokens), "uri string, n_tokens long, ordinal long, doc_id long"), "token-manifest")


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, index of the last or -1, lengths between them)."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return 0, len(ids), -1, at
    return len(at), int(at[0]), int(at[-1]), np.diff(at) - 1


def _scanner(separator: int):
    names = ["uri", "block", "n_tokens", "found", "head", "last", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_at(uri) as source:
                    ids = np.frombuffer(source.read_at((end - start) * _TYPE.itemsize, start * _TYPE.itemsize), _TYPE)
                n, head, last, inner = scan_block(ids, separator)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block]), pa.array([len(ids)]), pa.array([n]), pa.array([head]), pa.array([last]), pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))], names)

    return run


def count_tokens(files: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(uri, ordinal, n_tokens, ended) per document of the files in ``files`` (uri, n_tokens).

    Tokens after the last separator are a last document with ``ended`` false; an empty file has
    no document. ``n_tokens`` is without the separator.
    """
    spark = files.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(block_tokens).cast("long"))
    blocks = files.filter("n_tokens > 0").select("uri", F.col("n_tokens").alias("size"), F.posexplode(starts).alias("block", "start"))
    blocks = blocks.select("uri", F.col("block").cast("long").alias("block"), "start", F.least(F.col("start") + block_tokens, F.col("size")).alias("end"))
    schema = "uri string, block long, n_tokens long, found long, head long, last long, inner array<long>"
    found = materialize(blocks.repartition(n, "uri", "block").mapInArrow(_scanner(separator), schema), "token-blocks")

    order = Window.partitionBy("uri").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    scan = (
        found.drop("inner").withColumn("start", start)
        .withColumn("docs_before", F.coalesce(F.sum("found").over(before), F.lit(0)))
        .withColumn("mark", F.when(F.col("last") >= 0, F.col("start") + F.col("last") + 1))
        .withColumn("open_from", F.coalesce(F.max("mark").over(before), F.lit(0)))
        .withColumn("carried", F.col("start") - F.col("open_from"))
        .withColumn("is_last", F.lead("block").over(order).isNull())
        .select("uri", "block", "docs_before", "carried", "is_last", "found", "head", "last", "n_tokens")
    )
    at_end = F.when(F.col("found") > 0, F.col("n_tokens") - F.col("last") - 1).otherwise(F.col("carried") + F.col("n_tokens"))
    both = found.select("uri", "block", "inner").join(scan, ["uri", "block"])
    lengths = F.when(F.col("found") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    ended = both.select("uri", "docs_before", F.posexplode(lengths).alias("k", "n_tokens")).select("uri", (F.col("docs_before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    tail = scan.filter(F.col("is_last") & (at_end > 0)).select("uri", (F.col("docs_before") + F.col("found")).alias("ordinal"), at_end.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tail)


def token_report(docs: DataFrame, vocabulary: str = tok.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) per row of ``docs``, counted in the token files that its text was written to.

    Null and empty texts have no token; repeated rows, and rows without an id, are documents of
    their own. An empty table gives an empty table. Other columns are not looked at.
    """
    manifest = write_token_files(docs, vocabulary)
    separator = tok.load(docs.sparkSession, vocabulary).value.n
    files = materialize(manifest.select("uri", "n_tokens").distinct(), "token-files")
    counts = count_tokens(files, separator).drop("ended")
    return manifest.select("uri", "ordinal", "doc_id").join(counts, ["uri", "ordinal"]).select("doc_id", "n_tokens")
