"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark items (runs of ``n`` words; a shorter item is one window) are
hashed; the distinct windows form a broadcast hash set while they stay below a checked size.
Documents are read once: a text is parted into words once, every position of it is hashed in
generated code over each length that occurs, looked up by that hash alone, and each hit is
verified word by word. Beyond the checked size positions are shuffled as ids and hashes without
words, and only documents with a hit are parted again to verify it. Hits become intervals, and
the union of a document's intervals are its hit words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clash_free, materialize

WINDOW = 10
#: Most windows, and most items named with them, in the broadcast set, of some 300 bytes each; above, the join shuffles.
MAX_BROADCAST_WINDOWS = 500_000

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: Every ASCII character outside letters and digits parts words.
_PARTS = "".join(map(chr, [*range(0x01, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and nothing else: digits, ASCII letters, all beyond ASCII."""
    # translate() takes a zero character in its table as "delete", so that one goes first
    plain = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(" ")), _UPPER + _PARTS, _UPPER.lower() + " " * len(_PARTS))
    return F.array_remove(F.split(plain, " "), "")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _window_hash(length: int) -> Column:
    """Hash of the ``length`` words of ``tokens`` from ``start`` on; null where there are fewer."""
    within = F.col("start") + length <= F.size("tokens")
    return F.when(within, F.xxhash64(F.lit(length), *[F.get("tokens", F.col("start") + i) for i in range(length)]))


def _gram(length: str) -> Column:
    """The words themselves; no word has a blank, so joining them loses nothing."""
    return F.array_join(F.slice("tokens", F.col("start") + 1, F.col(length)), " ")


def _positions(rows: DataFrame) -> DataFrame:
    """rows(tokens, ...) -> a row per word and one past the last, with ``start``.

    The outer form of explode, as the inner one adds a filter that parts every text once more.
    """
    return rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.size("tokens"))).alias("start"))


def _probes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Positions with ``length`` and ``hash`` for each length, in one pass for all lengths."""
    at = _positions(rows)
    if len(lengths) == 1:
        return at.select("*", F.lit(lengths[0]).alias("length"), _window_hash(lengths[0]).alias("hash"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), _window_hash(n).alias("hash")) for n in lengths])).alias("probe")
    return at.select("*", each).select("*", "probe.length", "probe.hash").drop("probe")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, list[int], bool]:
    """Distinct windows (set_length, set_hash, gram, items), their lengths, and whether they may be broadcast.

    Items without a word have no window. Repeated items and windows count once; a null item_id
    has windows but is in no item list.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("tokens")).withColumn("own", F.least(F.size("tokens"), F.lit(n)))
    items = materialize(items.filter("own > 0"), "decontam-items")
    lengths = sorted(r[0] for r in items.select("own").distinct().collect()) or [n]  # at most n numbers
    own = F.coalesce(*[F.when(F.col("own") == k, _window_hash(k)) for k in lengths])
    parts = _positions(items).filter(F.col("start") + F.col("own") <= F.size("tokens")).select("item_id", F.col("own").alias("set_length"), own.alias("set_hash"), _gram("own").alias("gram"))
    grams = materialize(parts.groupBy("set_length", "set_hash", "gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")), "decontam-windows")
    size = grams.agg(F.count("*").alias("windows"), F.sum(F.size("items")).alias("named")).first()
    return grams, lengths, max(size["windows"], size["named"] or 0) <= MAX_BROADCAST_WINDOWS


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, start, length, items): each verified occurrence of a benchmark
    window, and for each row of ``docs`` one row whose ``items`` are null.
    """
    grams, lengths, small = benchmark_windows(benchmark, n)
    tokens = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("tokens"))
    probes = _probes(tokens, lengths)
    n_words = F.size("tokens").cast("long").alias("n_words")
    if small:
        # two bounds for equality of the words, which Spark would else put into the key and build at every position
        same = (F.col("hash") == F.col("set_hash")) & (_gram("length") >= F.col("gram")) & (_gram("length") <= F.col("gram"))
        whole = (F.col("start") == F.size("tokens")) & (F.col("length") == lengths[0])
        found = probes.join(F.broadcast(grams), same, "left").filter(F.col("gram").isNotNull() | whole)
        return materialize(found.select("doc_id", "text_key", n_words, "start", "length", "items"), "decontam-scan")

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("items", "array<string>"))]
    light = probes.filter(F.col("hash").isNotNull()).select("doc_id", "text_key", "start", "length", "hash")
    near = materialize(light.join(grams.select(F.col("set_hash").alias("hash")).distinct(), "hash", "left_semi").distinct(), "decontam-near")
    by = near.groupBy(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key")).agg(F.collect_list(F.struct("start", "length", "hash")).alias("near"))
    by = materialize(by, "decontam-near-documents")  # a row has at most a few entries per word of its own text
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_key") == F.col("near_key"))
    again = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").join(by, same).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("near").alias("near"))
    at = again.select("doc_id", "text_key", words(F.col("text")).alias("tokens"), F.explode_outer("near").alias("at")).select("doc_id", "text_key", "tokens", "at.*")
    at = at.select("doc_id", "text_key", F.size("tokens").cast("long").alias("n_words"), "start", "length", "hash", _gram("length").alias("own_gram"))
    found = at.join(grams, (F.col("hash") == F.col("set_hash")) & (F.col("own_gram") == F.col("gram"))).select("doc_id", "text_key", "n_words", "start", "length", "items")
    return materialize(found.unionByName(tokens.select("doc_id", "text_key", n_words, *nothing)), "decontam-scan")


def _contamination(scanned: DataFrame) -> DataFrame:
    hits = scanned.filter(F.col("items").isNotNull()).drop("n_words").distinct().withColumn("end", F.col("start") + F.col("length"))
    by = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.withColumn("reach", reach)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))
    island = F.sum((F.col("start") > F.col("reach")).cast("int")).over(by)
    merged = (
        spans.withColumn("fresh", fresh).withColumn("island", island)
        .groupBy("doc_id", "text_key", "island")
        .agg(F.min("start").alias("from"), F.max("end").alias("to"), F.sum("fresh").alias("fresh"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )
    out = merged.groupBy("doc_id", "text_key").agg(
        F.sum("fresh").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"),
    )
    return materialize(out, "decontam-bad")  # now the planner knows its size, and joins with it need no shuffle while it is small


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, text_key) of each document with a hit: n_hit, items, spans of hit words [from, to).

    Documents of equal id and text are judged once; a null id is an id like any other, and null
    text is empty. Overlapping windows are merged in a sorted stream; the state is one running
    maximum, however long the document is. An empty table or benchmark gives no row.
    """
    return _contamination(scan(docs, benchmark, n))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without their hit words.

    With spans removed, the text is what is left of its words, joined by single spaces; texts
    without a hit stay as they are. Null and empty texts have no words and stay. An empty
    benchmark or an empty table changes nothing. Repeated rows share a verdict. Columns of the
    result are those of ``docs``, whatever they are called.
    """
    bad = contamination(docs, benchmark, n)
    names = clash_free(docs, "bad_id", "bad_key", "spans")
    bad = bad.select(F.col("doc_id").alias(names["bad_id"]), F.col("text_key").alias(names["bad_key"]), F.col("spans").alias(names["spans"]))
    same = F.col("doc_id").eqNullSafe(F.col(names["bad_id"])) & (text_key(F.col("text")) == F.col(names["bad_key"]))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    spans = F.col(names["spans"])
    kept = F.filter(words(F.col("text")), lambda w, i: ~F.exists(spans, lambda s: (s["from"] <= i) & (i < s["to"])))
    text = F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return docs.join(bad, same, "left").withColumn("text", text).select(*docs.columns)


def decontam_report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hit. Repeated rows get a row each, with equal
    figures. Without items, or items with words, nothing is hit; an empty table gives an empty
    table. Other columns of ``docs`` are not looked at.
    """
    scanned = scan(docs, benchmark, n)
    bad = _contamination(scanned).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"), "n_hit", F.col("items").alias("bad_items"))
    rows = scanned.filter(F.col("items").isNull()).select("doc_id", "text_key", "n_words")
    out = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_key")), "left")
    items = F.coalesce("bad_items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


DECONTAM_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, n WHERE len(w) >= n)),
h AS (SELECT p.r, p.i, p.n, g.item_id FROM p JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
