"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master (driver and executors are one process) may run without the
    setting; a folder of our own is then set as the checkpoint folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"file:///tmp/checkpoints/{sc.applicationId}"
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def _remove_scratch() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may already be gone; the files are only scratch
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a recomputation), and gives the
    planner the table's true size, so that later joins broadcast only what really is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote. Only for tables that nothing reads any more."""
    for table in tables:
        if (path := getattr(table, "scratch_path", None)) is not None:
            _delete(table.sparkSession, path)
            _SCRATCH.remove((table.sparkSession, path))


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of plans that are gone removed; Spark waits for the driver's garbage collection with it."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
