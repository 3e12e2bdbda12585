"""Text expressions and helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_path

#: Java regex of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words (see WORD) of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clash_free(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for helper columns that ``df`` does not already have."""
    have = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        new = name
        while new.lower() in have:
            new = f"_{new}"
        have.add(new.lower())
        out[name] = new
    return out


__all__ = ["WORD", "clash_free", "materialize", "n_words", "scratch_path", "table"]
