"""The graph handle: four immutable tables, read lazily."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema as S
from .functions.types import pick_argument
from .plans.scratch import materialize


@dataclass(frozen=True)
class ProvGraph:
    """``nodes``, ``edges``, ``attrs``, ``namespaces`` and ``bundles`` of one document.

    Every edit returns a new handle. Views of an edge's direction: *wrap* (cause to effect) and
    *doc* (source to target as a document lists them); they differ for most relation kinds.
    """

    nodes: DataFrame
    edges: DataFrame
    attrs: DataFrame
    namespaces: DataFrame
    bundles: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **tables: DataFrame) -> ProvGraph:
        return replace(self, **tables)

    @property
    def directed(self) -> DataFrame:
        """``edges`` with cause, effect (wrap view) and src, dst (doc view; null where not seen)."""
        return self.edges.select(
            "*", pick_argument("wrap", 0).alias("cause"), pick_argument("wrap", 1).alias("effect"), pick_argument("doc", 0).alias("src"), pick_argument("doc", 1).alias("dst")
        )

    def view(self, name: str = "doc") -> DataFrame:
        """Edges of a view as (edge_id, relation, bundle_id, ordinal, src, dst); both ends known."""
        a, b = {"doc": ("src", "dst"), "wrap": ("cause", "effect")}[name]
        return self.directed.select("edge_id", "relation", "bundle_id", "ordinal", F.col(a).alias("src"), F.col(b).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")

    def adjacency(self, name: str = "doc") -> DataFrame:
        """Distinct (src, dst) without self-loops."""
        return self.view(name).filter("src <> dst").select("src", "dst").distinct()

    def materialized(self, *names: str) -> ProvGraph:
        """The same graph with some tables written once, for repeated use: nodes, edges and attributes unless named."""
        once = lambda name: t if hasattr(t := getattr(self, name), "scratch_path") else materialize(t, name)
        return self.with_(**{name: once(name) for name in names or ("nodes", "edges", "attrs")})

    def count(self) -> int:
        """Number of nodes."""
        return self.nodes.count()


def empty(spark: SparkSession) -> ProvGraph:
    make = lambda s: spark.createDataFrame([], s)
    known = spark.createDataFrame(list(S.KNOWN_PREFIXES.items()), S.NAMESPACES)
    return ProvGraph(make(S.NODES), make(S.EDGES), make(S.ATTRS), known, make(S.BUNDLES))


def graph_of(nodes: DataFrame, edges: DataFrame, attrs: DataFrame | None = None, namespaces: DataFrame | None = None, bundles: DataFrame | None = None, dedupe: bool = True, missing: DataFrame | None = None) -> ProvGraph:
    """A graph from record scans.

    Of records with one id the first by ``ordinal`` wins, then by bundle and kind. Endpoints that no record declares get a
    placeholder node of kind ``unknown``. Relations that lack an endpoint yield no edge. A source that knows which
    endpoints no record declares gives them as ``missing`` (node_id, ordinal); else all edges are held against all nodes.
    """
    base = empty(nodes.sparkSession)
    kept = edges.filter("arg1 IS NOT NULL AND arg2 IS NOT NULL")
    if dedupe:
        first = Window.partitionBy("node_id").orderBy("ordinal", "bundle_id", "kind")
        nodes = nodes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    graph = ProvGraph(nodes, kept, base.attrs if attrs is None else attrs, base.namespaces if namespaces is None else namespaces, base.bundles if bundles is None else bundles)
    return graph.with_(nodes=nodes.unionByName(placeholders(graph) if missing is None else _placeholder_rows(missing)))


def placeholders(graph: ProvGraph) -> DataFrame:
    """A node row for each endpoint that ``graph.nodes`` lacks."""
    ends = graph.edges.select(F.explode(F.array("arg1", "arg2")).alias("node_id"), "ordinal").groupBy("node_id").agg(F.min("ordinal").alias("ordinal"))
    return _placeholder_rows(ends.join(graph.nodes.select("node_id"), "node_id", "left_anti"))


def _placeholder_rows(missing: DataFrame) -> DataFrame:
    return missing.select(
        F.lit(None).cast("string").alias("bundle_id"), "node_id", F.lit("unknown").alias("kind"), F.array().cast(f"array<{S.TYPE}>").alias("types"), F.lit(None).cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"), F.lit(True).alias("is_placeholder"), "ordinal"
    )
