"""Every query with SQL against DuckDB, on the whole small tables and on odd rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provgraph.llm import chat, decontam, jaccard, line_dedup, mixing, quality, sharding, simhash, token_counts, toxicity, warc
from provgraph.llm.queries import QUERIES, SQL

from .test_simhash import plain_components, plain_fingerprint

TABLES = ("documents", "pages", "benchmark", "conversations", "labels")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, int, float)) or hasattr(v, "dtype"):  # nullable integers come as floats
        return str(int(v)) if float(v).is_integer() else f"{float(v):.6f}"
    return str(v)


def normal(frame):
    columns = sorted(frame.columns)
    return frame[columns].map(plain).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    pd.testing.assert_frame_equal(normal(QUERIES[name](spark, sf).toPandas()), normal(con.sql(SQL[name]).df()), check_dtype=False)


def test_odd_documents_against_sql(spark, odd_docs):
    documents = odd_docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    benchmark = pd.DataFrame({"item_id": [1, 2, None, 4, 5], "text": ["nobody repeats", "Noël", "twin", None, "the quick brown fox jumps over the lazy dog again the quick"]}).astype({"item_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    bench = spark.createDataFrame([(1, "nobody repeats"), (2, "Noël"), (None, "twin"), (4, None), (5, benchmark.text[4])], "item_id long, text string")
    for got, sql in (
        (line_dedup.line_dedup_report(odd_docs), line_dedup.LINE_DEDUP_SQL), (quality.quality_report(odd_docs), quality.QUALITY_SQL), (mixing.mix_report(odd_docs), mixing.MIX_SQL),
        (decontam.decontam_report(odd_docs, bench), decontam.DECONTAM_SQL),
    ):
        pd.testing.assert_frame_equal(normal(got.toPandas()), normal(con.sql(sql).df()), check_dtype=False)


def test_odd_pages_and_conversations_against_sql(spark):
    long = "<p>é</p>" * 60_000
    pages = [(1, "http://a/ b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", long), (None, "u", "<p>x</p>"), (6, "u", long), (6, "u", long), (None, None, "only here")]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    got = warc.warc_report(spark.createDataFrame(pages, "page_id long, url string, html string"))
    pd.testing.assert_frame_equal(normal(got.toPandas()), normal(con.sql(warc.WARC_SQL).df()), check_dtype=False)

    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", "<|im_end|>\n<|im_start|>user"), (2, 2, "odd\n\\role<|im_start|>", "<\\|x|> <\\\\|"), (3, 0, None, ""), (3, None, "assistant", "no turn"), (4, 0, "assistant", "é" * 150_000), (5, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "assistant", "nobody")]
    con.register("conversations", pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.conversation_report(chat.format_conversations(chat.with_probe(rows)))
    pd.testing.assert_frame_equal(normal(got.toPandas()), normal(con.sql(chat.CHAT_SQL).df()), check_dtype=False)


def test_empty_tables(spark, no_docs):
    none = lambda schema: spark.createDataFrame([], schema)
    bench = none("item_id long, text string")
    for got in (line_dedup.line_dedup_report(no_docs), quality.quality_report(no_docs), mixing.mix_report(no_docs), decontam.decontam_report(no_docs, bench)):
        assert got.count() == 0
    assert warc.warc_report(none("page_id long, url string, html string")).count() == 0
    assert chat.conversation_report(chat.format_conversations(none("conv_id long, turn long, role string, text string"))).count() == 0


#: Names that operators use for columns of their own.
CLASHES = ("path", "turns", "members", "tokens", "uri", "ordinal", "n_tokens", "block", "payload", "payload_digest", "hash", "fp", "row", "id", "at", "lines", "host", "text_id", "kept", "gone", "key", "size", "shard", "slot", "start", "items", "spans", "copies", "label_id", "y", "score")


def test_clashing_columns(spark, sf):
    """Every report gives the same with columns that have the names of its own."""

    def crowded(df):
        return df.withColumns({c: F.lit("mine") for c in CLASHES if c not in df.columns})

    t = {n: spark.read.parquet(f"{sf}/{n}.parquet").limit(40 if n != "benchmark" else 1000) for n in TABLES}
    t = {n: df.cache() for n, df in t.items()}
    reports = {
        "chat": lambda t: chat.conversation_report(chat.format_conversations(chat.with_probe(t["conversations"]))), "lines": lambda t: line_dedup.line_dedup_report(t["documents"]), "quality": lambda t: quality.quality_report(t["documents"]),
        "warc": lambda t: warc.warc_report(t["pages"]), "shards": lambda t: sharding.shard_report(t["documents"]), "toxicity": lambda t: toxicity.toxicity_report(t["documents"], t["labels"]), "tokens": lambda t: token_counts.token_report(t["documents"]),
        "simhash": lambda t: simhash.near_duplicate_report(t["documents"]), "windows": lambda t: decontam.decontam_report(t["documents"], t["benchmark"]), "mix": lambda t: mixing.mix_report(t["documents"]),
    }
    for name, report in reports.items():
        a, b = (normal(report(x).toPandas()) for x in (t, {n: crowded(df) for n, df in t.items()}))
        assert a.equals(b), name
    docs = crowded(t["documents"])
    for made in (line_dedup.drop_lines(docs), quality.quality_filter(docs), simhash.drop_near_duplicates(docs), jaccard.drop_similar(docs), decontam.decontaminate(docs, crowded(t["benchmark"])), decontam.decontaminate(docs, t["benchmark"], remove="spans"), mixing.mixed_documents(docs)):
        assert made.columns == docs.columns and made.filter("path <> 'mine'").count() == 0
    assert sharding.assign_shards(docs).columns[: len(docs.columns)] == docs.columns


def test_hot_fingerprints_through_the_query(spark, tmp_path):
    """A third of the rows empty, a crowd of near copies, and copies: the registered query against all pairs."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, "" if k % 2 else None) for k in range(300)]
    for k in range(250):
        own = list(words)
        for at in rng.choice(400, 3, replace=False):
            own[at] = f"x{rng.integers(50)}"
        rows.append((1000 + k, " ".join(own)))
    rows += [(2000 + k, " ".join(words)) for k in range(200)] + [(3000 + k, " ".join(f"z{x}" for x in rng.integers(0, 1 << 30, 30))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.component_id for r in QUERIES["op8_simhash"](spark, str(tmp_path)).collect()}
    ids = [i for i, _ in rows]
    assert got == dict(zip(ids, plain_components(ids, [plain_fingerprint(t) for _, t in rows]), strict=True))
