"""The near-dedup stage against exact Jaccard similarity of all pairs."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provgraph.llm import jaccard, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_kept(rows):
    """The least id of each component of pairs with similarity >= 0.8."""
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return sorted(set(root.values()))


def edited(words, k, rng):
    out = list(words)
    for at in rng.choice(len(words), k, replace=False):
        out[at] = f"z{rng.integers(1 << 40)}"
    return " ".join(out)


def test_stage_finds_pairs_beyond_four_bits(spark, sf):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, edited(words, 4, rng)), (len(rows) + 2, edited(words, 30, rng))]
    bits = [(simhash.fingerprint(rows[k][1]) ^ simhash.fingerprint(rows[k + 1][1])).bit_count() for k in range(0, 90, 3)]
    assert max(bits) > 4  # the old setting keeps these
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in stage(spark, docs, sf).collect()) == want and len(want) == 60


def test_stage_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in jaccard.drop_similar(docs).collect()) == plain_kept(rows)


def test_recall_on_planted_near_copies(spark):
    """Pairs between 0.8 and 0.95 of many lengths; of 200 all are found, and none of 100 pairs below 0.8."""
    rng = np.random.default_rng(11)
    rows, near = [], set()
    while len(rows) < 600:
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, int(rng.integers(30, 600)))]
        a, b = len(rows), len(rows) + 1
        other = edited(words, max(1, int(len(words) * rng.uniform(0.004, 0.05))), rng)
        x, y = plain_set(" ".join(words)), plain_set(other)
        close = 5 * len(x & y) >= 4 * len(x | y)
        if close and len(near) < 200 or not close and len(rows) // 2 - len(near) < 100:
            rows += [(a, " ".join(words)), (b, other)]
            near |= {b} if close else set()
    kept = {r.doc_id for r in jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - near and len(near) == 200


@pytest.mark.parametrize("tile", [7, 1024])
def test_links_of_a_crowd(spark, tile):
    """A chain of edits in one long run: ends are far apart, neighbours are near."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    rows = []
    for k in range(40):
        words[7 * k % 300] = f"c{k}"
        rows.append((k, " ".join(words)))
    texts = spark.createDataFrame(rows, "fp long, text string").withColumn("row", F.col("fp").cast("string"))
    own = texts.select("fp", "row", F.array(F.lit(0).cast("long")).alias("keys"))
    member = simhash.components(jaccard.links(texts.select("row", "text"), own, tile=tile)).toPandas()
    assert len(member) == 40 and member.root.nunique() == 1


def test_simhash_pairs_are_candidates_without_a_band_in_common(spark):
    """No two texts share a key here: what SimHash links is still found, if its shingles are similar."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 900)]
    repeated = [" ".join(words[:11] * 400 + [f"x{k}y{i}" for i in range(40)]) for k in range(2)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), *repeated, "one of its own"]
    sims = [simhash.fingerprint(t) for t in texts]
    assert all((sims[k] ^ sims[k + 1]).bit_count() <= simhash.DISTANCE for k in (0, 2))
    rows = [(k, str(k), [k], s - (1 << 64) if s >> 63 else s) for k, s in enumerate(sims)] + [(9, "9", [9], sims[4] - (1 << 64) if sims[4] >> 63 else sims[4])]
    own = spark.createDataFrame(rows, "fp long, row string, keys array<long>, sim long")
    more = jaccard.simhash_pairs(own.select("fp", "sim"))
    assert {tuple(r) for r in more.collect()} == {(0, 1), (2, 3), (4, 9)}
    found = jaccard.links(spark.createDataFrame([*((str(k), t) for k, t in enumerate(texts)), ("9", texts[4])], "row string, text string"), own, more=more)
    assert {tuple(r) for r in found.collect()} == {(0, 1), (4, 9)}
