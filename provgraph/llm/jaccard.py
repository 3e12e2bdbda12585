"""Near duplicates by SimHash and MinHash candidates, verified by Jaccard similarity of word shingles.

Texts whose SimHash fingerprints ``simhash.py`` links are candidates. Few texts at similarity 0.8 are that close, so
MinHash bands look for the rest.
Texts whose MinHash agrees in all rows of a band are candidates; two texts at similarity 0.8 miss
each other in all 32 bands of 5 rows three times in a million. Copies collapse first. Candidates
are verified on their whole shingle sets (64-bit hashes): pair by pair in short runs; a long run is
cut into tiles that are compared pair by pair of tiles and yield a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Runs of so many texts yield all their pairs; rows of a longer run that are compared as one tile.
SHORT, TILE = 16, 1024
#: Shingles whose MinHash is taken at a time.
_CHUNK = 1 << 10

_RNG = np.random.default_rng(42)
_MUL, _ADD, _WORD = (_RNG.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, 64))


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(found: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    if len(found) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - shingle + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(shingle):
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ each[k : k + n]) * _WORD[k]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def band_keys(found: np.ndarray) -> list[int]:
    """A hash of the MinHash rows of each band."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), _CHUNK):
        low = np.minimum(low, (_MUL[:, None] * found[None, k : k + _CHUNK] + _ADD[:, None]).min(1))
    return [xxhash.xxh3_64_intdigest(row.tobytes()) - (1 << 63) for row in low.reshape(BANDS, ROWS)]


def text_key(found: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(found)) - (1 << 63)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            found = [words_of(t) for t in part.column(2).to_pylist()]
            keys = [band_keys(shingles(w)) for w in found]
            sim = np.array([simhash.fingerprint(t) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([text_key(w) for w in found], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sim)], ["id", "row", "fp", "keys", "sim"])


def _forest(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Spanning forest of the similar pairs: breadth first, each row against those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(sizes)[:-1])
    seen = np.zeros(int(codes.max()) + 1, bool)
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        flat = None
        while queue and len(left):
            at = queue.pop()
            if flat is None:
                flat, starts = np.concatenate([own[k] for k in left]), np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
            seen[own[at]] = True
            both = np.add.reduceat(seen[flat], starts, dtype=np.int64)
            seen[own[at]] = False
            close = both >= similarity * (sizes[left] + sizes[at] - both) - 1e-9
            if close.any():
                found = left[close].tolist()
                yield from ((at, k) for k in found)
                queue.extend(found)
                left, flat = left[~close], None


def links(texts: DataFrame, own: DataFrame, similarity: float = SIMILARITY, short: int = SHORT, tile: int = TILE, more: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b) of similar texts that connect what is connected.

    ``own`` has a row (fp, row, keys) per distinct text, ``texts`` has (row, text); ``more`` has further
    candidates (a, b), a < b. Only texts that share a key with another, or are in ``more``, are fetched.
    """
    keyed = own.select("fp", F.posexplode("keys").alias("band", "key"))
    counts = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = materialize(keyed.join(counts, ["band", "key"]), "jaccard-runs")
    either = rows.select("fp") if more is None else rows.select("fp").union(more.select(F.explode(F.array("a", "b"))))
    wanted = materialize(own.select("fp", "row").join(either.distinct(), "fp", "left_semi"), "jaccard-wanted")
    needed = materialize(texts.join(wanted, "row").groupBy("fp").agg(F.first("text").alias("text")), "jaccard-texts")
    runs = rows.filter(F.col("n") <= short).groupBy("band", "key").agg(F.collect_set("fp").alias("x"))
    pairs = runs.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).filter("a < b")
    pairs = (pairs if more is None else pairs.union(more.select("a", "b"))).distinct()
    pairs = pairs.join(needed.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(needed.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = shingles(words_of(x)), shingles(words_of(y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")

    # a run of n rows is cut into g parts; part pairs (i, j), i <= j, are the tiles
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    crowd = rows.filter(F.col("n") > short).withColumn("parts", F.ceil(F.col("n") / tile).cast("int")).withColumn("part", part)
    crowd = crowd.withColumn("tile", F.explode(tiles)).select("band", "key", "tile.i", "tile.j", "fp").join(needed, "fp")
    crowd = crowd.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fps, sets = None, [], []

        def flush() -> pd.DataFrame:
            ends = [(min(fps[x], fps[y]), max(fps[x], fps[y])) for x, y in _forest(sets, similarity)] if len(sets) > 1 else []
            return pd.DataFrame(ends, columns=["a", "b"], dtype="int64")

        for frame in frames:
            for band, key, i, j, fp, text in frame[["band", "key", "i", "j", "fp", "text"]].itertuples(index=False):
                if at != (band, key, i, j):
                    yield flush()
                    at, fps, sets = (band, key, i, j), [], []
                fps.append(fp)
                sets.append(shingles(words_of(text)))
        yield flush()

    return found.union(crowd.select("band", "key", "i", "j", "fp", "text").mapInPandas(run, "a long, b long")).distinct()


def simhash_pairs(own: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """(a, b), a < b, of texts whose fingerprints (``sim`` of ``own``, beside fp) SimHash links, or are equal.

    Of texts with one fingerprint the one with the least fp stands for it, and is paired with the others.
    """
    first = own.groupBy(F.col("sim").alias("s")).agg(F.min("fp").alias("first"))
    end = lambda c: first.select(F.col("s").alias(c), F.col("first").alias(f"first_{c}"))
    near = simhash.links(first.select(F.col("s").alias("fp")), distance).join(end("a"), "a").join(end("b"), "b").select("first_a", "first_b")
    same = own.join(first, F.col("sim") == F.col("s")).filter("fp <> first").select("first", "fp")
    x, y = F.col("first_a"), F.col("first_b")
    return near.union(same).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, distance: int = simhash.DISTANCE) -> DataFrame:
    """``docs`` with one document of each component of similar texts: the one with the least id, null ids last.

    Candidates have SimHash fingerprints at most ``distance`` bits apart, or a MinHash band in common. Texts without
    a word, null among them, are alike. Of rows that share the id, the one with the least MD5 of id and text stays,
    once. Columns are those of ``docs``, whatever they are called. An empty table gives an empty table.
    """
    keyed = simhash.row_keyed(docs)
    rows = materialize(keyed.select("id", "row", "text").mapInArrow(_keys, "id long, row string, fp long, keys array<long>, sim long"), "jaccard-rows")
    own = rows.groupBy("fp").agg(F.first("keys").alias("keys"), F.min("row").alias("row"), F.min("sim").alias("sim"))
    own = materialize(own, "jaccard-own")
    more = materialize(simhash_pairs(own.select("fp", "sim"), distance), "jaccard-simhash")
    member = simhash.components(links(keyed.select("row", "text"), own, similarity, more=more))
    found = rows.drop("keys", "sim").join(member, rows.fp == member.node, "left").withColumn("root", F.coalesce("root", "fp"))
    return simhash.one_of_each(keyed, found)
