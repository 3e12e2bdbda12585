"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint is split into ``n`` blocks, at least ``distance + 2``; two fingerprints at most
``distance`` bits apart agree in ``n - distance`` blocks at least, so every close pair meets under
one of the keys made of that many. The more fingerprints, the more blocks, and so the wider the
keys: a key has about 64 * (n - distance) / n bits, and a run of equal keys stays short.
Fingerprints, not documents, are joined: copies collapse first. Under a key the rows are
compared in sorted runs; a long run is cut into tiles that are compared pair by pair of tiles, so
no task holds a whole hot run, and a run yields a spanning forest of its links, never all pairs.
Components come from the library's rounds of contracting links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import contract
from .common import materialize

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Rows of a run that are compared as one tile.
TILE = 4096
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles, repeats included; no words: 0.

    A-Z are lower-cased, words are runs without ASCII white space, a text of fewer words than a
    shingle is one shingle. A bit is set if it is set in over half of the hashes.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist(), strict=True)
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for k in range(0, n, _CHUNK):
        part = hashes[k : k + _CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: Column, shingle: int = SHINGLE) -> DataFrame:
    """(*keep, fp): the fingerprint of each row's text as a signed long."""
    out = docs.select(*keep, F.col("text").alias("_text"))
    fields = [f for f in out.schema.fields if f.name != "_text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fp)], [*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " if fields else "") + "fp long"
    return out.mapInArrow(run, schema)


def n_blocks(fingerprints: int, distance: int) -> int:
    """The fewest blocks whose keys are so wide that unrelated fingerprints fill runs of four on average at most."""
    n = distance + 2
    while n < 2 * distance + 2 and fingerprints > 4 << (64 * (n - distance) // n):
        n += 1
    return n


def _block_masks(distance: int, n: int) -> list[int]:
    """Bit masks of every ``n - distance`` of ``n`` blocks of 64 bits."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, n - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Distinct (a, b) of fingerprints at most ``distance`` bits apart that connect what is connected.

    ``fps`` has distinct ``fp``. Short runs yield all their links; a tile pair of a long run
    yields a spanning forest of them. ``blocks`` changes the plan, not the result.
    """
    masks = [_signed(m) for m in _block_masks(distance, blocks or n_blocks(fps.count(), distance))]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key")
    keyed = fps.select("fp", keys)
    counts = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = keyed.join(counts, ["block", "key"])
    # a run of n rows is cut into g parts; part pairs (i, j), i <= j, are the tiles
    parts = F.ceil(F.col("n") / tile).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    rows = rows.withColumn("parts", parts).withColumn("part", part).withColumn("tile", F.explode(tiles)).select("block", "key", "tile.i", "tile.j", "fp")
    rows = rows.repartition("block", "key", "i", "j").sortWithinPartitions("block", "key", "i", "j", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            ids = frame[["block", "key", "i", "j"]].to_numpy()
            new = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from _compare(frame["fp"].to_numpy()[:cut].view(np.uint64), np.concatenate(([0], new)), distance)
            rest = frame.iloc[cut:]
        if rest is not None and len(rest):
            yield from _compare(rest["fp"].to_numpy().view(np.uint64), np.array([0, len(rest)]), distance)

    return rows.mapInPandas(run, "a long, b long").distinct()


def _compare(fp: np.ndarray, edges: np.ndarray, distance: int) -> Iterator[pd.DataFrame]:
    """Links within the runs ``fp[edges[k]:edges[k + 1]]``."""
    fp = np.ascontiguousarray(fp)
    sizes = np.diff(edges)
    short = sizes <= 64
    run = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.repeat(short, sizes)
    a, b = [], []
    for step in range(1, int(sizes[short].max(initial=1))):
        near = (run[step:] == run[:-step]) & inside[step:]
        at = np.flatnonzero(near)
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        a.append(fp[at])
        b.append(fp[at + step])
    for k in np.flatnonzero(~short):
        for x, y in _forest(fp[edges[k] : edges[k + 1]], distance):
            a.append(x)
            b.append(y)
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        keep = x != y
        x, y = x[keep].view(np.int64), y[keep].view(np.int64)
        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links in one run: breadth first, each row against those not reached yet."""
    left = np.unique(fp)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(left ^ at) <= distance
            if close.any():
                found = left[close]
                yield np.full(len(found), at, np.uint64), found
                queue.extend(found)
                left = left[~close]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node of each connected component is its root."""
    member = contract(edges)
    if member is not None:
        return member.join(member.groupBy("root").agg(F.min("node").alias("least")), "root").select("node", F.col("least").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(id, fp) rows -> (fp, root, component_id): the component and the least id in it."""
    own = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fingerprints")
    member = components(links(own.select("fp"), distance))
    joined = own.join(member, own.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(joined.join(lowest, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows keep
    their place. A null id never names a component unless all ids of the component are null.
    An empty table gives an empty table; other columns are not looked at.
    """
    rows = materialize(fingerprints(docs, F.col("doc_id"), shingle=shingle), "simhash-rows")
    return rows.join(classes(rows.select(F.col("doc_id").alias("id"), "fp"), distance), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id, null ids last.

    Of rows that share this id, the one with the least MD5 of id and text stays, once; of rows
    equal in both, the one with the least MD5 of all its columns. Columns are those of ``docs``,
    whatever they are called. An empty table gives an empty table.
    """
    keyed = row_keyed(docs)
    rows = materialize(fingerprints(keyed, F.col("id"), F.col("row"), shingle=shingle), "simhash-rows")
    return one_of_each(keyed, rows.join(classes(rows.select("id", "fp"), distance), "fp"))


def row_keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, id, row): ``row`` is the MD5 of id and text."""
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x01"), F.coalesce("text", F.lit(""))))
    return docs.select(F.struct("*").alias("doc"), "text", F.col("doc_id").alias("id"), row.alias("row"))


def one_of_each(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of ``keyed`` whose ``row`` comes first in a root of ``found`` (id, row, root).

    The documents are shuffled once; only rows that are repeated are grouped as well.
    """
    first = found.groupBy("root", "row").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    kept = first.groupBy("root").agg(F.min_by(F.struct("row", "n"), F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("x"))
    kept = materialize(kept.groupBy("x.row").agg(F.max("x.n").alias("n")), "one-of-each")
    once = keyed.select("row", "doc").join(kept.withColumnRenamed("row", "kept_row"), F.col("row") == F.col("kept_row")).select("row", "doc", "n")
    repeated = once.filter("n > 1").groupBy("row").agg(F.min_by("doc", F.md5(F.to_json("doc"))).alias("doc"))
    return once.filter("n = 1").select("doc.*").union(repeated.select("doc.*"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id; see ``near_duplicates`` for odd rows."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
