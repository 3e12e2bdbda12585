"""The operators' own interfaces and outputs, where SQL has no word for them."""

import hashlib
import io
import json
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provgraph.llm import chat, decontam, line_dedup, mixing, quality, sharding, simhash, token_counts, tokens, toxicity, warc
from provgraph.llm.queries import QUERIES

from .conftest import LONG


# --- chat


@given(st.text(alphabet="<|\\im_startend>\n", max_size=30))
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "\n" not in chat.escape_role(text)


def test_shared_turns_are_emitted_once(spark):
    rows = [(c, 0, "user", "the same first turn") for c in range(50)] + [(c, 1, "assistant", f"answer {c % 5}") for c in range(50)]
    packs = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    nodes = [n for p in packs for n in p.nodes]
    assert len(nodes) <= 6 * len(packs) and sum(len(p.members) for p in packs) == 50
    for p in packs:
        for n in p.nodes:
            own = [i for a in n.attends for i in range(a["from"], a["to"])]
            assert [p.position_ids[i] for i in own] == list(range(n.position))  # ancestors, from the root on
            assert p.position_ids[n.start : n.end] == list(range(n.position, n.position + n.end - n.start))


def test_packs_close_at_their_size(spark):
    rows = [(c, 0, "user", f"first {c % 3} " * 20) for c in range(30)] + [(c, 1, "assistant", f"reply {c} " * 20) for c in range(30)]
    packs = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), max_tokens=400, max_members=4)
    got = packs.select(F.size("tokens").alias("n"), F.size("members").alias("m")).collect()
    assert sum(r.m for r in got) == 30 and max(r.m for r in got) <= 4 and max(r.n for r in got) <= 400
    assert chat.conversation_report(packs).select("turns_sha256").distinct().count() == 30


# --- line dedup


def test_keep_bitmaps_and_lines_across_partitions(spark):
    """A line of every document, so that its rows fill several partitions."""
    common = "This line of more than forty characters is everywhere, in any case."
    rows = [(i, f"{common.upper() if i % 2 else common}  \nown line number {i} which is long enough to be looked at too\n{common}") for i in range(400)] + [(None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[399].n_dropped == 0 and all(got[i].n_dropped == 2 for i in range(399)) and got[None].n_dropped == 1
    assert np.unpackbits(np.frombuffer(zlib.decompress(got[5].bitmap), np.uint8), count=3).tolist() == [0, 1, 0]
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert kept[7] == "own line number 7 which is long enough to be looked at too" and kept[None] == "" and kept[399].count("\n") == 2


# --- quality


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeat_words_by_brute_force(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    want = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    assert quality.repeat_words(words) == len(want)


def test_repeat_words_of_a_large_vocabulary():
    words = [str(i).encode() for i in range(20_000)]
    assert quality.repeat_words(words + words[100:110]) == 20
    assert quality.repeat_words(words) == 0


def test_quality_filter(spark, odd_docs, no_docs):
    name = lambda i: "".join("klmnopqrst"[int(d)] for d in str(i))  # noqa: E731  digits are all alike to the rules
    shared = "Subscribe to our newsletter for more of this"
    rows = [(i, f"{shared}\nA document about topic {name(i)} with quite a few words of its own, {name(i)} to be sure.", "host") for i in range(60)]
    rows += [(100 + i, f"{shared}\n{shared.upper()}\nLess {i}", "host") for i in range(3)] + [(200, "word " * 40, "host"), (201, rows[0][1], "host")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality.quality_filter(docs).collect()}
    assert set(kept) == {*range(60), 201}
    assert shared not in kept[3] and "topic n" in kept[3]
    assert quality.quality_filter(docs, strip=False).filter("doc_id = 3").first().text == rows[3][1]
    assert {r.doc_id for r in quality.quality_filter(odd_docs).collect()} == {1}
    assert quality.quality_filter(odd_docs).columns == odd_docs.columns
    assert quality.quality_filter(no_docs).count() == 0


def test_long_lines_are_boilerplate_too(spark):
    name = lambda i: "".join("klmnopqrst"[int(d)] for d in str(i))
    terms = " ".join(f"licence{name(k)}" for k in range(60))
    rows = [(i, f"{terms}\n" + " ".join(f"{name(i)}{name(k)}" for k in range(40)), "host") for i in range(25)] + [(99, f"{terms}\nlittle else", "host")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality.quality_filter(docs).collect()}
    assert set(kept) == set(range(25)) and not any(terms in t for t in kept.values())
    assert {r.n_left for r in quality.judge(docs).filter("doc_id < 99").collect()} == {40}


def test_line_limit_does_not_grow_with_the_host(spark):
    name = lambda i: "".join("klmnopqrst"[int(d)] for d in str(i))
    rows = [(i, " ".join(f"{name(i)}{name(k)}" for k in range(20)) + ("\nall rights reserved" if i < 25 else "\nsome rights reserved" if i < 45 else ""), "host") for i in range(3000)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.n_left) for r in got.filter("n_left < n_words").collect()} == {(i, 20) for i in range(25)}


# --- WARC


def test_reader_splits_anywhere(spark):
    rows = [(i, f"http://x/{i}", "<html>" + "é\x1f" * (i * 37 % 5000) + str(i) + "</html>") for i in range(80)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), file_bytes=6000)
    assert files.count() > 1 and files.agg(F.sum("records")).first()[0] == 80
    for split in (64, 1000, 1 << 20):
        got = warc.read_archives(files, split_bytes=split)
        assert got.filter("digest_ok").count() == 80 and got.select("page_id").distinct().count() == 80
    text = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(files, 500).collect()}
    assert text == {i: h for i, _, h in rows}


def test_false_magic_and_damage_are_skipped():
    good = [warc.member(warc.warc_record(i, "u", b"payload %d" % i, warc.payload_digest(b"payload %d" % i), None)) for i in range(3)]
    data = b"junk" + warc.MAGIC + b"\x00nonsense" + good[0] + good[1][:40] + warc.member(b"no record") + good[2] + warc.MAGIC

    class Source(io.BytesIO):
        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    found = list(warc.scan_range(Source(data), len(data), 0, len(data)))
    assert [warc.parse(r)[2] for _, r in found] == [b"payload 0", b"payload 2"]


# --- sharding


def test_placement_by_brute_force(spark, sf):
    """The registered query against a plain schedule of the same units, and the imbalance that comes of it."""
    got = {r.doc_id: r.shard for r in QUERIES["op5_sharding"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    keys = {r.doc_id: hashlib.md5((r.text or "").encode()).digest() for r in docs}
    size = Counter()
    for r in docs:
        size[keys[r.doc_id]] += len((r.text or "").encode()) + 16
    bins, total = 40 * 1024, sum(size.values())

    def unit(key):
        return f"g{key.hex().upper()}" if size[key] * bins >= total else f"b{simhash._signed(xxhash.xxh64_intdigest(key, 42)) % bins}"

    units = Counter()
    for key, n in size.items():
        units[unit(key)] += n
    load, where = [0] * 40, {}
    for name, n in sorted(units.items(), key=lambda u: (-u[1], u[0])):
        shard = min(range(40), key=lambda s: (load[s], s))
        load[shard] += n
        where[name] = shard
    assert got == {i: where[unit(k)] for i, k in keys.items()}
    assert max(load) - min(load) <= max(units.values())


def test_shards(spark, odd_docs, no_docs, sf):
    got = QUERIES["op5_sharding"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(got) == len(docs) and set(got.law) == {"bytes"} and got.shard.between(0, 39).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    both = got.merge(docs, on="doc_id")
    assert (both["size"] == [len(t.encode()) + 16 for t in both.text]).all()
    assert (both.text_crc32 == [zlib.crc32(t.encode()) for t in both.text]).all()
    assert both.groupby("text").shard.nunique().max() == 1
    groups = both.groupby("text")["size"].sum()
    load = both.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert load.max() - load.min() <= groups.max()
    out = sharding.assign_shards(odd_docs, 3)
    assert out.columns == [*odd_docs.columns, "_size", "text_crc32", "shard", "slot"] and out.count() == odd_docs.count()
    assert sharding.assign_shards(no_docs).count() == 0


def test_bins_balance_many_small_groups(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("pad")).select("doc_id", F.concat("pad", F.col("doc_id").cast("string")).alias("text"))
    got = sharding.shard_report(docs, n_shards=4, grain=16).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= got["size"].sum() / (4 * 16) * 2


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_lpt_ends_one_unit_apart(sizes, n):
    placed = sharding.lpt([(s, str(i)) for i, s in enumerate(sizes)], n)
    load = [0] * n
    for i, s in enumerate(sizes):
        load[placed[str(i)]] += s
    assert max(load) - min(load) <= max(sizes)


# --- token counts


def test_token_counts_by_brute_force(spark, sf, odd_docs, no_docs):
    tokenizer = tokens.load(spark).value
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = QUERIES["op7_token_counts"](spark, sf).toPandas()
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == {i: len(tokenizer.encoding.encode_ordinary(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    odd = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_report(odd_docs).collect())
    assert odd == Counter((r.doc_id, len(tokenizer.encoding.encode_ordinary(r.text or ""))) for r in odd_docs.collect())
    assert token_counts.token_report(no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_are_stitched(spark, tmp_path, block):
    eod = 9
    files = []
    for k, ids in enumerate(([1, 2, 9, 9, 3, 9], [9], [1, 2, 3, 4, 5, 6, 7, 8], [1, 9, 2, 3])):
        path = tmp_path / f"{k}.tok"
        np.array(ids, "<u2").tofile(path)
        files.append((f"file://{path}", len(ids)))
    got = token_counts.count_tokens(spark.createDataFrame(files, "uri string, n_tokens long"), eod, block).collect()
    rows = sorted((r.uri[-5], r.ordinal, r.n_tokens, r.ended) for r in got)
    assert rows == [("0", 0, 2, True), ("0", 1, 0, True), ("0", 2, 1, True), ("1", 0, 0, True), ("2", 0, 8, False), ("3", 0, 1, True), ("3", 1, 2, False)]


def test_long_texts_have_the_same_tokens(spark):
    tokenizer = tokens.load(spark).value
    text = LONG + "  \n" + LONG.upper()
    assert tokenizer.encode(text) == tokenizer.encoding.encode_ordinary(text)
    rng = np.random.default_rng(1)
    pick = lambda letters, n: "".join(np.array(list(letters))[rng.integers(0, len(letters), n)])
    odd = ["a" * 295_002, "§" * 320_001, "日本語" * 100_000, "日本語、はい。" * 60_000, " " * 300_000 + "a", "\n\t\u3000" * 90_000 + "z", "a" * 131_072 + "'s" * 100_000, "a\n" * 200_000, pick("ab1 \n\t'é日.\u3000", 400_000), pick("abcXYZ0189+/='s", 400_000)]
    odd.append("".join(map(chr, np.where((points := rng.integers(1, 0x10FFFF, 300_000)) // 0x800 == 0x1B, 65, points))))
    for text in odd:
        assert tokenizer.encode(text) == tokenizer.encoding.encode_ordinary(text)


# --- toxicity


def test_automaton_by_brute_force():
    lexicon = toxicity.Lexicon({"moron": 5.0, "clown": 4.0, "bad": 3.0}, {"vile": 2.0})
    assert lexicon.match("moron") == (5.0, 0, "moron") and lexicon.match("vilest")[1] == 0 and lexicon.match("m0ron")[1] == 1
    letters = "morncla"

    def near(word, term):
        if len(term) < 5:
            return word == term
        edits = {term} | {term[:i] + term[i + 1 :] for i in range(len(term))}
        edits |= {term[:i] + c + term[i + k :] for i in range(len(term) + 1) for c in letters for k in (0, 1)}
        return word in edits

    rng = np.random.default_rng(3)
    for _ in range(3000):
        base = list(rng.choice(["moron", "clown", "bad"]))
        for _ in range(rng.integers(0, 3)):
            i = rng.integers(0, len(base) + 1)
            base[i : i + rng.integers(0, 2)] = list(rng.choice([*letters, ""]))
        word = "".join(base)
        assert (lexicon.match(word) is not None) == any(near(word, t) for t in ("moron", "clown", "bad")), word


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon({"moron": 5.0}, {})
    abuse, quote = (toxicity.features(lexicon, t) for t in ("You are a moron, you know that.", 'The paper wrote "he called them a moron" and left.'))
    assert quote[0] < abuse[0] and quote[1] < abuse[1]


def test_masked_words_are_seen():
    lexicon = toxicity.Lexicon({"moron": 5.0, "idiot": 4.0, "scum": 3.0}, {})
    score = lambda t: toxicity.features(lexicon, t)[0]
    assert min(score(t) for t in ("you m0r0n", "you mor@n", "an id*ot!", "an !diot", "what $cum")[:3]) > 0 and score("what $cum") > 0
    assert score("wow!great*thing a@b.c $100 5*5") == 0


def test_many_quoted_hits_take_linear_time():
    lexicon = toxicity.Lexicon({"moron": 5.0}, {})
    text = 'he said "you moron" and "moron" again ' * 20_000
    began = time.perf_counter()
    assert toxicity.features(lexicon, text)[0] > 0
    assert time.perf_counter() - began < 5


def test_clashing_columns_of_labelled_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", 1, 2, "h") for i in range(9)], "doc_id long, text string, y int, label_id int, toxic string")
    labels = spark.createDataFrame([(i, i % 2, 5, "t") for i in range(9)], "doc_id long, toxic int, y int, text string")
    assert toxicity.toxicity_report(docs, labels).count() == 9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = got[got.toxic == 1].predicted.mean()
    assert got.score.between(0, 1).all() and hit >= 0.9 and got[got.toxic == 0].predicted.mean() <= 0.01


def test_toxicity_edge_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.toxicity_report(odd_docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity_report(no_docs, labels).count() == 0


# --- decontamination


def test_spans_are_removed(spark, odd_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "solo")], "item_id long, text string")
    rows = [(1, "Start ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda end"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "a solo here, solo!"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {2, 4}
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert got == {1: "start end", 2: rows[1][1], 3: "a here", 4: None}
    assert decontam.decontaminate(odd_docs, bench).columns == odd_docs.columns
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 4


def test_shuffled_set_gives_the_same(spark, sf, monkeypatch):
    a = QUERIES["op9_decontamination"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    b = QUERIES["op9_decontamination"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b) and a.contaminated.any()


@pytest.mark.parametrize("limit", [0, 500_000])
def test_no_words_are_shuffled(spark, sf, monkeypatch, limit):
    """One pass over the texts finds windows of all lengths; exchanges carry ids, hashes and hits."""
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", limit)
    seen = []
    written = decontam.materialize

    def spy(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(decontam, "materialize", spy)
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, "one two three four five six seven eight nine ten eleven"), (3, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "zero one two three four five six seven eight nine ten"), (3, "nothing here"), (4, "solo solo")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.decontam_report(docs, bench).collect()}
    assert got == {1: (4, 3, 1), 2: (11, 10, 1), 3: (2, 0, 0), 4: (2, 2, 1)}
    plan = dict(seen)["decontam-scan" if limit else "decontam-near"]
    assert plan.count("FileScan") <= 3 and plan.count("split(") == 1
    for name, text in seen:
        for part in text.split("Exchange ")[1:]:
            below = part.split("\n")[1]
            assert name in ("decontam-items", "decontam-windows") or "tokens" not in below.split("[")[-1], (name, below)


# --- mixing


def test_no_third_copy(spark):
    """Rows without words, in a source that the mix takes twice as a whole."""
    rows = [(i, "" if i % 3 else "one two", "a") for i in range(30)] + [(100 + i, "word " * 200, s) for i, s in enumerate("bbbc")] + [(200, " ", "d"), (201, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert {copies[i] for i in range(30)} == {2} and max(copies.values()) == 2


def test_mix_is_near_its_targets(spark, sf, odd_docs, no_docs):
    got = mixing.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1e-6).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) > 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_thresholds_are_nested(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small, large = (mixing.mix(docs, share=s).select("doc_id", "copies").toPandas().set_index("doc_id").copies for s in (0.4, 0.8))
    assert (large >= small).all() and json.dumps(sorted(set(small))) != "[]"
