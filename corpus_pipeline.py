"""The corpus pipeline: documents in, shards out, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``, whatever they are called. All stages take null and very
long texts, null ids and sources, repeated rows and empty tables; what each does with them is in
its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provgraph.llm import decontam, jaccard, mixing, quality, sharding
from provgraph.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line frequencies reject go; shared lines go from the rest.

    Null and empty texts go, as they have no words; a null source is a host like any other; repeated
    rows go or stay together. Whole copies of a text count as one document here, so that near dedup,
    which follows, can keep one of each group. An empty table stays empty.
    """
    return quality.quality_filter(docs, copies_once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 5-word Jaccard >= 0.8 stays: the one with the least id.

    Candidates have SimHash fingerprints at most four bits apart, as in ``op8_simhash``; as these find few pairs at
    that similarity, MinHash bands give further ones (see the README). All are verified on their shingles. Texts without a word are alike; null ids come last; of repeated rows one stays. An
    empty table stays empty.
    """
    return jaccard.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null and empty texts stay, as they have no words; repeated rows share a verdict; without items
    nothing goes. An empty table stays empty.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice.

    A null source is a source, last in order; rows equal in id and text are taken alike; texts
    without words have size 0 and follow their hash. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it.

    Equal texts share a shard, null and empty ones among them; every repeated row has a slot of its
    own; a null id sorts first. An empty table stays empty.
    """
    return sharding.assign_shards(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("sharding", sharded)]

#: SQL has neither the fingerprints nor the schedule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the whole table, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
