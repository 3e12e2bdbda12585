"""Rows of the graph tables from columns of a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import no_types, types_of
from ..graph import ProvGraph, empty, graph_of


def id_of(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.concat_ws(":", *[F.col(p).cast("string") for p in parts]))


def node_rows(rows: DataFrame, bundle: str | Column, node_id: Column, kind: str, *types: str, start: Column | None = None, end: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("timestamp")
    return rows.select(
        (F.lit(bundle) if isinstance(bundle, str) else bundle).alias("bundle_id"), node_id.alias("node_id"), F.lit(kind).alias("kind"), (types_of(*types) if types else no_types()).alias("types"),
        (null if start is None else start.cast("timestamp")).alias("start_time"), (null if end is None else end.cast("timestamp")).alias("end_time"), F.lit(False).alias("is_placeholder"), (F.lit(0) if ordinal is None else ordinal).cast("long").alias("ordinal"),
    )


def edge_rows(rows: DataFrame, bundle: str | Column, relation: str, arg1: Column, arg2: Column, edge_id: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    """Without ids of their own, edges are named by the relation and its ends, alike in every run."""
    made = F.concat_ws("|", F.lit(relation), arg1, arg2)
    own = made if edge_id is None else F.coalesce(edge_id, made)
    return rows.select((F.lit(bundle) if isinstance(bundle, str) else bundle).alias("bundle_id"), own.alias("edge_id"), F.lit(relation).alias("relation"), arg1.alias("arg1"), arg2.alias("arg2"), (F.lit(0) if ordinal is None else ordinal).cast("long").alias("ordinal"))


def attr_rows(rows: DataFrame, record_id: Column, **values: str | Column) -> DataFrame:
    """One row per value that is there. A keyword ``p__x`` names ``p:x``, one without ``__`` gets ``attr:``."""
    pairs = F.array(*[
        F.struct(F.lit(k.replace("__", ":") if "__" in k else f"attr:{k}").alias("name"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value"), F.lit(rows.schema[c].dataType.simpleString() if isinstance(c, str) else "string").alias("value_type"))
        for k, c in values.items()
    ])
    made = rows.select(record_id.alias("record_id"), F.lit("node").alias("record_class"), F.inline(pairs), F.lit(0).cast("long").alias("ordinal"))
    return made.filter("value IS NOT NULL").select("record_id", "record_class", "name", "value", "value_type", "ordinal")


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def graph_from(spark: SparkSession, nodes: DataFrame, edges: DataFrame, attrs: DataFrame | None = None, namespaces: dict[str, str] | None = None, dedupe: bool = False, missing: DataFrame | None = None) -> ProvGraph:
    base = empty(spark)
    names = base.namespaces if not namespaces else base.namespaces.unionByName(spark.createDataFrame(list(namespaces.items()), "prefix string, uri string")).dropDuplicates(["prefix"])
    return graph_of(nodes, edges, base.attrs if attrs is None else attrs, names, nodes.select("bundle_id").filter("bundle_id IS NOT NULL").distinct(), dedupe, missing)
