"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash. Per source, the words of the rows are summed by the leading
12 bits of the hash; the bucket in which the running sum reaches the source's budget is the
boundary bucket, and only its rows are looked at again by the next 12 bits, down to a single
hash. The mix then is a filter ``hash <= threshold``: no sort of the rows, reruns agree, and
a larger budget keeps all that a smaller one took.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clash_free, materialize, n_words

HASH_BITS, STEP_BITS = 60, 12
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MAX_REPEAT = 1.5, 2


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text. Only rows equal in both share a hash."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Targets share ``share`` of all words by weight. A target above ``max_repeat`` times its
    source's size stops there, and the excess goes to the others by weight until none is
    above. Sources sorted by size per weight reach their cap in that order, so the first one
    that is not capped, given all before it are, fixes the level of all the rest. This table
    has one row per source; its windows need one task.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = every.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    filled = (
        ranked.withColumn("weight", w)
        .withColumn("place", F.row_number().over(order))
        .withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(max_repeat)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(onward))
        .withColumn("free", F.col("pool") * F.col("weight") <= cap * F.col("weights_left"))
        .withColumn("first_free", F.min(F.when(F.col("free"), F.struct("place", "pool", "weights_left"))).over(every))
    )
    level = F.col("first_free.pool") * F.col("weight") / F.col("first_free.weights_left")
    target = F.when(F.col("place") >= F.col("first_free.place"), level).otherwise(cap)
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(ledger: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, size, hash) rows -> one row per source: target, whole copies, hash threshold.

    A row with ``hash <= threshold`` is taken ``whole + 1`` times, any other ``whole`` times.
    """
    sizes = ledger.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, max_repeat)
    # a source at its cap has nothing left to share out: a budget of 0 takes no row once more, not even one without words
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("whole", whole).withColumn("budget", F.when(F.col("whole") < max_repeat, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)), "mix-targets")

    state = plan.select("source", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        state = materialize(_refine(ledger, state, shift), "mix-boundary")
    # the last bucket is one hash: take it if that comes nearer to the budget
    take = (F.col("budget") > 0) & (F.lit(2) * (F.col("budget") - F.col("below")) >= F.col("inside"))
    edge = state.select(F.col("source").alias("s"), F.when(take, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("threshold"))
    return plan.join(edge, plan.source.eqNullSafe(edge.s), "left").select(plan.source, "source_size", "weight", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("threshold"))


def _refine(ledger: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """The boundary bucket of each source among the next bits of the rows in its last one."""
    at = state.select(F.col("source").alias("s"), "budget", F.col("bucket").alias("last"), "below")
    hist = (
        ledger.join(at, ledger.source.eqNullSafe(at.s) & (F.shiftright(F.col("hash"), shift + STEP_BITS) == F.col("last")))
        .groupBy("s", F.shiftright("hash", shift).alias("bucket"))
        .agg(F.sum("size").alias("inside"), F.first("budget").alias("budget"), F.first("below").alias("below"))
    )
    by = Window.partitionBy("s").orderBy("bucket")
    upto = F.col("below") + F.sum("inside").over(by)
    reached = hist.withColumn("upto", upto).filter(F.col("upto") >= F.col("budget"))
    return (
        reached.groupBy("s").agg(F.min_by(F.struct("budget", "bucket", "upto", "inside"), F.col("bucket")).alias("b"))
        .select(F.col("s").alias("source"), "b.budget", "b.bucket", (F.col("b.upto") - F.col("b.inside")).alias("below"), "b.inside")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` with a column ``copies``: how often the mix takes each row.

    Null text has size 0; a null source is a source of its own, last in order; null ids are
    told apart by their text. Rows equal in id and text share a hash and are taken together.
    An empty table gives an empty table. If ``docs`` has a column ``copies``, ours is ``_copies``.
    """
    names = clash_free(docs, "copies", "hash", "size", "s")
    sized = docs.withColumn(names["hash"], row_hash(F.col("doc_id"), F.col("text"))).withColumn(names["size"], n_words(F.col("text")))
    ledger = materialize(sized.select("source", F.col(names["size"]).alias("size"), F.col(names["hash"]).alias("hash")), "mix-ledger")
    plan = materialize(mix_plan(ledger, weights, share, max_repeat), "mix-plan").select(F.col("source").alias(names["s"]), F.struct("whole", "threshold").alias(names["copies"]))
    taken = F.col(names["copies"])
    hashed = docs.withColumn(names["hash"], row_hash(F.col("doc_id"), F.col("text")))
    copies = (taken["whole"] + (F.col(names["hash"]) <= taken["threshold"]).cast("int")).cast("int")
    return hashed.join(plan, F.col("source").eqNullSafe(F.col(names["s"]))).withColumn(names["copies"], copies).drop(names["hash"], names["s"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows repeated as often as taken, with the columns of ``docs``."""
    name = clash_free(docs, "copies")["copies"]
    out = mix(docs, **options)
    return out.filter(F.col(name) > 0).withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(name)))).select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, its source's size and target, and the words that the mix takes of it.

    Null text has size 0; a null source is a source of its own, last in order. Rows equal in id
    and text are taken alike. An empty table gives an empty table; other columns are not looked at.
    """
    ledger = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-ledger")
    plan = materialize(mix_plan(ledger), "mix-plan").withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("whole") + (F.col("hash") <= F.col("threshold")).cast("long"))
    return ledger.join(plan, ledger.source.eqNullSafe(plan.s)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
p AS (SELECT *, row_number() OVER o AS place,
             1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS pool,
             sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
      FROM r WINDOW o AS (ORDER BY source_size / weight, rank)),
f AS (SELECT place AS k, pool AS kpool, weights_left AS kleft FROM p WHERE pool * weight <= 2.0::DOUBLE * source_size * weights_left ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN place >= k THEN kpool * weight / kleft ELSE 2.0::DOUBLE * source_size END AS target FROM p, f),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM w),
h AS (SELECT source, hash, sum(size)::BIGINT AS inside, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash)::BIGINT AS upto FROM d GROUP BY source, hash),
e AS (SELECT b.source, min(hash) AS edge, arg_min(upto - inside, hash) AS below, arg_min(inside, hash) AS inside, any_value(budget) AS budget
      FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source WHERE upto >= budget GROUP BY b.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.whole + CASE WHEN d.hash < e.edge OR (d.hash = e.edge AND 2 * (e.budget - e.below) >= e.inside) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
