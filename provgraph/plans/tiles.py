"""Joins whose rows grow with the square of a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Rows of a key that a tile has of either side, about; rows that a task makes, about; tasks at most.
SIDE, TASK, TASKS = 1024, 1 << 21, 4096


def meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, which may have few values with many rows.

    The rows of a key are cut into tiles of about ``SIDE`` rows of either side, dealt out evenly. A row is shuffled
    once for each tile across, one time for ``SIDE`` rows that it makes; the rows made are not shuffled.
    """
    n = a.groupBy(*keys).agg(F.count("*").alias("_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_b")), keys)
    n = materialize(n, "tiles")
    tasks = min(TASKS, max(1, -(-int(n.agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0) // TASK)))
    cuts = n.select(*keys, F.ceil(F.col("_a") / SIDE).alias("_na"), F.ceil(F.col("_b") / SIDE).alias("_nb"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1)).alias(f"_{other}")
        mine = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.col(f"_n{own}")).alias(f"_{own}")
        out = rows.join(cuts, keys).select(*rows.columns, mine, each)
        return out.repartition(tasks, *keys, "_a", "_b")

    return dealt(a, "a", "b").join(dealt(b, "b", "a").hint("merge"), [*keys, "_a", "_b"]).drop("_a", "_b")
