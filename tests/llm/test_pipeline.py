"""The pipeline stage by stage, each against a plain version on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from provgraph.llm import decontam, mixing, quality

from .test_jaccard import plain_kept


def plain_line(line):
    """A-Z lower-cased, digits to 0, words joined by single blanks; None without a word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return " ".join(w for w in low.split(" ") if w) or None


def plain_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    return len({j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)})


def plain_quality(rows, copies_once, limit=20):
    """{doc_id: (n_left, kept, text without the removed lines)} by counting every line of every document."""
    having = defaultdict(set)
    for r in rows:
        for line in {plain_line(x) for x in (r.text or "").split("\n")} - {None}:
            having[r.source, line].add(r.text if copies_once else r.doc_id)
    out = {}
    for r in rows:
        words = (r.text or "").encode().split()
        stay = [x for x in (r.text or "").split("\n") if len(having.get((r.source, plain_line(x)), ())) <= limit]
        left = sum(len(x.encode().split()) for x in stay)
        kept = len(words) >= 10 and 100 * plain_repeats(words) <= 20 * len(words) and left >= 10 and left >= 0.3 * len(words)
        out[r.doc_id] = left, kept, "\n".join(stay)
    return out


def test_quality_against_plain_counts(spark):
    """The operator counts documents, the pipeline's stage whole copies once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    for limit in (2, 20):  # no line of this table is in more than 20 documents of a host
        want = plain_quality(rows, False, limit)
        got = {r.doc_id: (r.n_left, r.kept) for r in quality.judge(docs, limit).collect()}
        assert got == {i: x[:2] for i, x in want.items()}
        assert limit == 20 or any(x[0] < len((r.text or "").encode().split()) for r, x in zip(rows, want.values(), strict=True))
        want = plain_quality(rows, True, limit)
        got = {r.doc_id: r.text for r in quality.quality_filter(docs, max_docs=limit, copies_once=True).collect()}
        assert got == {i: t for i, (_, kept, t) in want.items() if kept}
    stage = dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, "")
    assert {r.doc_id: r.text for r in stage.collect()} == got


def test_copies_are_documents(spark):
    """100 equal texts of a host: their lines are in 100 documents, unless copies count once."""
    text = "A first line with quite a few words in it\nand a second line with as many words as that"
    docs = spark.createDataFrame([(i, text, "h") for i in range(100)] + [(1, text, "h")] * 50 + [(200 + i, f"{text} {i}", "i") for i in range(21)], "doc_id long, text string, source string")
    got = quality.judge(docs)
    assert {(r.n_left, r.kept) for r in got.filter("host = 'h'").collect()} == {(0, False)}
    assert {r.n_left for r in got.filter("host = 'i'").collect()} <= {0, 11}  # the last number is a 0 like any other digit
    assert quality.judge(docs, copies_once=True).filter("host = 'h' AND NOT kept").count() == 0


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, sf).cache()
    plain = plain_quality(docs.collect(), True)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, (_, k, t) in plain.items() if k} and kept.columns == columns

    single = stages["near dedup"](spark, kept, sf).cache()
    want = plain_kept([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in single.collect()) == want and single.columns == columns

    clean = stages["decontamination"](spark, single, sf).cache()

    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in low).split(" ")

    grams = set()
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = [x for x in words(item.text) if x]
        grams |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(0, len(w) - 10) + 1)} if w else set()
    lengths = {len(g) for g in grams}

    def hit(text):
        w = [x for x in words(text) if x]
        return any(tuple(w[i : i + n]) in grams for n in lengths for i in range(len(w) - n + 1))

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not hit(r.text)} and clean.columns == columns
    assert decontam.contamination(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0

    mixed = stages["mixture"](spark, clean, sf).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    report = {r.doc_id: r for r in mixing.mix_report(clean).collect()}
    assert all(times[i] * r.size == r.taken for i, r in report.items()) and max(times.values()) <= 2 and mixed.columns == columns

    last = stages["sharding"](spark, mixed, sf).toPandas()
    assert Counter(last.doc_id) == times and last.groupby("text").shard.nunique().max() == 1
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in last.groupby("shard"))


def test_run_is_the_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "mixture", "sharding"]
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b and a


def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.count()
