"""Sharding by longest-processing-time scheduling of groups that must stay together.

Rows of equal text form a group. A group of at least ``1 / (n_shards * grain)`` of all bytes is
scheduled on its own; there are at most ``n_shards * grain`` of these. All smaller groups are put
into ``n_shards * grain`` bins by a hash of their key, and a bin is scheduled like a group. So
however many rows there are, the heap gets at most ``2 * n_shards * grain`` units, the driver
holds no more than these, and the map from unit to shard is a broadcast of proven size. Units go
by falling size to the least-loaded shard; loads end at most one unit apart unless a single
group outweighs a fair share, which must stay together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clash_free, materialize

N_SHARDS, GRAIN, SLOT_BUCKETS = 40, 1024, 1024
#: Most units that the driver schedules and broadcasts; ``grain`` shrinks for more shards.
MAX_UNITS = 1 << 18
ROW_BYTES = 16


def group_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def lpt(units: list[tuple[int, str]], n_shards: int) -> dict[str, int]:
    """Units (size, name) by falling size, ties by name, to the least-loaded shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bin(key: Column, n_bins: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_bins)).cast("int")


def schedule(ledger: DataFrame, n_shards: int = N_SHARDS, grain: int = GRAIN) -> tuple[DataFrame, DataFrame, int]:
    """(key, size) rows -> (large: key, shard), (bins: bin, shard), number of bins."""
    spark = ledger.sparkSession
    grain = max(1, min(grain, MAX_UNITS // (2 * n_shards)))
    n_bins = n_shards * grain
    groups = materialize(ledger.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * n_bins >= F.lit(total)
    unit = F.when(large, F.concat(F.lit("g"), F.hex("key"))).otherwise(F.concat(F.lit("b"), _bin(F.col("key"), n_bins).cast("string")))
    # at most 2 * n_bins rows: that many large groups cannot exceed n_bins, and bins are n_bins
    rows = groups.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")).toPandas()
    placed = lpt(list(zip(rows["size"].tolist(), rows["unit"].tolist(), strict=True)), n_shards)
    big = [(bytearray(bytes.fromhex(u[1:])), s) for u, s in placed.items() if u[0] == "g"]
    small = [(int(u[1:]), s) for u, s in placed.items() if u[0] == "b"]
    return spark.createDataFrame(big, "key binary, shard int"), spark.createDataFrame(small, "bin int, shard int"), n_bins


def place(rows: DataFrame, large: DataFrame, bins: DataFrame, n_bins: int) -> DataFrame:
    """``shard`` for rows with a column ``key``: two lookups in maps of proven size, no shuffle."""
    large = large.select(F.col("key").alias("large_key"), F.col("shard").alias("large_shard"))
    bins = bins.select(F.col("bin").alias("at_bin"), F.col("shard").alias("bin_shard"))
    return (
        rows.join(F.broadcast(large), F.col("key") == F.col("large_key"), "left")
        .join(F.broadcast(bins), _bin(F.col("key"), n_bins) == F.col("at_bin"), "left")
        .withColumn("shard", F.coalesce("large_shard", "bin_shard"))
        .drop("large_key", "large_shard", "at_bin", "bin_shard")
    )


def number_slots(rows: DataFrame) -> DataFrame:
    """``slot``: 0, 1, ... within each shard, by doc_id within a hash bucket of the shard.

    Rows are numbered within (shard, bucket), so no task gets a whole shard; a table of
    ``n_shards * SLOT_BUCKETS`` counts says where each bucket starts.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "shard"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.row_number().over(own) - 1)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", group_key(text).alias("key"), row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), *more)


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, grain: int = GRAIN) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1, ... in each shard).

    Null text counts as empty: size 16, CRC 0, and the same group as empty texts. Repeated rows
    are rows of their own. A null id sorts first. An empty table gives an empty table. Columns
    that already have one of these names keep it, and ours gets a leading underscore.
    """
    ledger = materialize(_keyed(docs).select("key", "size"), "shard-ledger")
    large, bins, n_bins = schedule(ledger, n_shards, grain)
    out = number_slots(place(_keyed(docs, F.struct("*").alias("doc")), large, bins, n_bins))
    names = clash_free(docs, "size", "text_crc32", "shard", "slot")
    return out.select("doc.*", *[F.col(c).alias(new) for c, new in names.items()])


def shard_report(docs: DataFrame, n_shards: int = N_SHARDS, grain: int = GRAIN) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`)."""
    ledger = materialize(_keyed(docs), "shard-ledger")
    large, bins, n_bins = schedule(ledger.select("key", "size"), n_shards, grain)
    out = number_slots(place(ledger, large, bins, n_bins))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
