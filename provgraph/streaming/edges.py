"""Edges that arrive as a stream: incremental degrees and per-window relation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path


def event_edges(events: DataFrame) -> DataFrame:
    """Edges (ts, relation, src, dst) of an event stream: each event is associated with its user."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("association").alias("relation"), F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("src"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("dst"))


def windowed_counts(edges: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Edges per relation and event-time window; a window is final ``late`` after its end."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", window), "relation").agg(F.count("*").alias("n_edges")).select(F.col("window.start").alias("window_start"), "relation", "n_edges")


def degrees(edges: DataFrame) -> DataFrame:
    """Running degree of each target."""
    return edges.groupBy("dst").agg(F.count("*").alias("degree"))


def drain(spark: SparkSession, query: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a streaming query over what is there now and return its final table.

    Each batch of a complete-mode query replaces the table; the state and the checkpoint are in
    the shared folder, so a restarted run goes on where it stopped.
    """
    out, state = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"stream-state-{name}")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(query.schema).parquet(out)


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may be a file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{path}*")
