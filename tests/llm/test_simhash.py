"""SimHash against a plain version on every pair, and its edge cases."""

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from provgraph.llm import simhash
from provgraph.llm.queries import QUERIES


def plain_fingerprint(text):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    grams = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance=4):
    fp = np.array(fps, np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for k, x in enumerate(ids):
        r = find(k)
        least[r] = x if r not in least or (x is not None and (least[r] is None or x < least[r])) else least[r]
    return [least[find(k)] for k in range(len(ids))]


def test_query_on_whole_table(spark, sf):
    got = QUERIES["op8_simhash"](spark, sf).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == plain_components(docs.doc_id.tolist(), fps)


def test_spark_hashes_shingles_alike(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("un deux très bien"))).first()[0] & (1 << 64) - 1
    assert simhash.fingerprint("Un deux\ttrès bien") == h


def test_blocks_grow_with_the_table():
    assert [simhash.n_blocks(n, 4) for n in (0, 10**5, 10**7, 10**8, 10**9, 10**12)] == [6, 6, 7, 7, 8, 10]
    for n in (6, 8, 10):
        masks = simhash._block_masks(4, n)
        rng = np.random.default_rng(n)
        for _ in range(300):  # any four bits leave a key whole
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flip & m for m in masks)


@pytest.mark.parametrize(("tile", "blocks"), [(3, None), (4096, None), (16, 8)])
def test_links_of_crowded_fingerprints(spark, tile, blocks):
    """Chains, crowds around one value and far strangers; tiles cut the crowd's runs."""
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(150)}
    fps |= {sum(1 << b for b in range(k)) for k in range(0, 60, 4)} | {int(x) for x in rng.integers(0, 1 << 63, 60)}
    fps = sorted(fps)
    ids = list(range(len(fps)))
    rows = spark.createDataFrame(pd.DataFrame({"id": ids, "fp": np.array(fps, np.uint64).view(np.int64)}))
    member = simhash.components(simhash.links(rows.select("fp"), tile=tile, blocks=blocks))
    got = rows.join(member, rows.fp == member.node, "left").select("id", F.coalesce("root", "fp").alias("root")).toPandas()
    least = got.groupby("root").id.transform("min")
    assert dict(zip(got.id, least, strict=True)) == dict(zip(ids, plain_components(ids, fps), strict=True))


def test_long_chain_of_components(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5000, 5001), (7, 7)], "a long, b long")
    got = simhash.components(edges).toPandas()
    assert len(got) == n + 3
    assert got[got.node <= n].root.nunique() == 1 and got.root.nunique() == 2


def test_edge_cases(spark):
    long = "word " * 200_000
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "a b", None), (3, "a b", None), (4, long, "l"), (5, long + "tail", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[(1, 0)] == got[(2, 0)] == 1
    assert {v for (k, _), v in got.items() if k in (None, 3)} == {3}
    assert {v for (k, _), v in got.items() if k in (4, 5)} == {4}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    twins = spark.createDataFrame([(1, "a b", "later"), (1, "a b", "first")], "doc_id long, text string, doc string")
    assert simhash.drop_near_duplicates(twins).collect() == simhash.drop_near_duplicates(twins.orderBy("doc")).collect() and simhash.drop_near_duplicates(twins).count() == 1
    none = docs.limit(0)
    assert simhash.near_duplicate_report(none).count() == 0 == simhash.drop_near_duplicates(none).count()
    nameless = spark.createDataFrame([(None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert simhash.drop_near_duplicates(nameless).count() == 2
