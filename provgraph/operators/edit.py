"""Edits: functions from graph to graph. Nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import InvalidOperationError, MultipleNodesError, NodeNotFoundError
from ..functions.names import attribute_name
from ..functions.types import is_relation, no_types, types_of
from ..graph import ProvGraph

KINDS = ("entity", "activity", "agent")


def _next_ordinal(*frames: DataFrame) -> int:
    highest = [f.agg(F.max("ordinal")).first()[0] for f in frames]
    return max([x for x in highest if x is not None], default=-1) + 1


def _attr_rows(g: ProvGraph, record_id: str, record_class: str, attributes: Mapping[str, object] | None) -> DataFrame:
    rows = []
    for name, value in (attributes or {}).items():
        for v in value if isinstance(value, (list, tuple, set)) else [value]:
            rows.append((record_id, record_class, name, None if v is None else str(v), type(v).__name__, len(rows)))
    made = g.spark.createDataFrame(rows, S.ATTRS)
    return made.withColumn("name", attribute_name(F.col("name")))


def add_node(g: ProvGraph, kind: str, node_id: str, attributes: Mapping[str, object] | None = None, prov_type: str | Iterable[str] | None = None, start_time: str | None = None, end_time: str | None = None, bundle_id: str | None = None) -> ProvGraph:
    """A new declared node; an id in use or an unknown kind raises. A placeholder is replaced."""
    if kind.lower() not in KINDS or not node_id:
        raise InvalidOperationError(f"cannot add {kind!r} {node_id!r}")
    same = g.nodes.filter(F.col("node_id") == node_id)
    if not same.filter("NOT is_placeholder").isEmpty():
        raise InvalidOperationError(f"{node_id} is in use")
    names = [prov_type] if isinstance(prov_type, str) else list(prov_type or ())
    row = g.spark.range(1).select(
        F.lit(bundle_id).cast("string").alias("bundle_id"), F.lit(node_id).alias("node_id"), F.lit(kind.lower()).alias("kind"), types_of(*names).alias("types"),
        F.lit(start_time).cast("timestamp").alias("start_time"), F.lit(end_time).cast("timestamp").alias("end_time"), F.lit(False).alias("is_placeholder"), F.lit(_next_ordinal(g.nodes)).cast("long").alias("ordinal"),
    )
    return g.with_(nodes=g.nodes.filter(F.col("node_id") != node_id).unionByName(row), attrs=g.attrs.unionByName(_attr_rows(g, node_id, "node", attributes)))


def add_nodes(g: ProvGraph, rows: DataFrame, attrs: DataFrame | None = None) -> ProvGraph:
    """Many new nodes at once: ``rows`` as in schema.NODES, of which bundle, types and times may lack.

    Ids in use, ids given twice and unknown kinds raise; placeholders are replaced. One check and
    no job per node; the order of arrival is that of the ids.
    """
    rows = rows.select("node_id", F.lower("kind").alias("kind"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("bundle_id", "string"), ("start_time", "timestamp"), ("end_time", "timestamp"))], (F.col("types") if "types" in rows.columns else no_types()).alias("types"))
    declared = g.nodes.filter("NOT is_placeholder").select("node_id")
    bad = rows.filter(~F.col("kind").isin(*KINDS) | F.col("node_id").isNull()).select(F.coalesce("node_id", F.lit("null")).alias("node_id"))
    bad = bad.union(rows.join(declared, "node_id", "left_semi").select("node_id")).union(rows.groupBy("node_id").count().filter("count > 1").select("node_id"))
    if first := bad.first():
        raise InvalidOperationError(f"{first.node_id} is in use, given twice, or of no kind")
    start = _next_ordinal(g.nodes)
    new = rows.withColumn("is_placeholder", F.lit(False)).withColumn("ordinal", F.lit(start).cast("long")).select(g.nodes.columns)
    nodes = g.nodes.join(rows.select("node_id"), "node_id", "left_anti").select(g.nodes.columns).unionByName(new)
    return g.with_(nodes=nodes, attrs=g.attrs if attrs is None else g.attrs.unionByName(attrs))


def add_edges(g: ProvGraph, rows: DataFrame) -> ProvGraph:
    """Many new relations at once: ``rows`` (relation, arg1, arg2, and edge_id or bundle_id where known).

    Arguments go in formal order. An end that is no node raises; relations without an id are named
    by their kind and ends.
    """
    name = F.coalesce(*[F.when(F.lower("relation").isin(r.name, r.verb.lower(), *r.aliases), F.lit(r.name)) for r in S.RELATIONS.values()])
    made = rows.select(
        (F.col("bundle_id") if "bundle_id" in rows.columns else F.lit(None)).cast("string").alias("bundle_id"), (F.col("edge_id") if "edge_id" in rows.columns else F.lit(None)).cast("string").alias("edge_id"), name.alias("relation"), "arg1", "arg2", F.lit(_next_ordinal(g.edges)).cast("long").alias("ordinal")
    ).withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("|", "relation", "arg1", "arg2")))
    ends = made.select(F.explode(F.array("arg1", "arg2")).alias("node_id")).distinct()
    if missing := ends.join(g.nodes.select("node_id"), "node_id", "left_anti").first():
        raise NodeNotFoundError(missing.node_id)
    if not made.filter("relation IS NULL").isEmpty():
        raise InvalidOperationError("unknown relation")
    return g.with_(edges=g.edges.unionByName(made))


class EdgeBuilder:
    """Collects what an edge needs; ``build`` adds it to a graph.

    A divided edge has a relation row for each of its relations, a merged one only for the first.
    """

    def __init__(self):
        self.relations: list[str] = []
        self.ends: dict[str, str] = {}
        self.edge_id: str | None = None
        self.divided = False

    def with_relation(self, relation: str) -> EdgeBuilder:
        self.relations = [S.relation_name(relation), *self.relations[1:]]
        return self

    def with_relations(self, relations: Iterable[str]) -> EdgeBuilder:
        self.relations = [S.relation_name(r) for r in relations]
        return self.as_divided()

    def with_cause(self, node_id: str) -> EdgeBuilder:
        self.ends["cause"] = node_id
        return self

    def with_effect(self, node_id: str) -> EdgeBuilder:
        self.ends["effect"] = node_id
        return self

    def with_identifier(self, edge_id: str) -> EdgeBuilder:
        self.edge_id = edge_id
        return self

    def as_divided(self) -> EdgeBuilder:
        self.divided = True
        return self

    def as_merged(self) -> EdgeBuilder:
        self.divided = False
        return self

    def build(self, g: ProvGraph) -> ProvGraph:
        lacking = [x for x, there in (("relation", self.relations), ("cause", "cause" in self.ends), ("effect", "effect" in self.ends)) if not there]
        if lacking:
            raise ValueError(f"an edge needs a {lacking[0]}")
        kinds = self.relations if self.divided else self.relations[:1]
        rows = [(r, self.ends["effect"], self.ends["cause"], self.edge_id if k == 0 else None) for k, r in enumerate(kinds)]
        return add_edges(g, g.spark.createDataFrame(rows, "relation string, arg1 string, arg2 string, edge_id string"))


def remove_node(g: ProvGraph, node_id: str, kind: str | None = None) -> ProvGraph:
    """Without the node, its attributes and its edges; several kinds under one id need ``kind``."""
    found = g.nodes.filter(F.col("node_id") == node_id)
    if kind is None and found.select("kind").distinct().limit(2).count() > 1:
        raise MultipleNodesError(f"{node_id} has several kinds")
    if found.isEmpty():
        raise NodeNotFoundError(node_id)
    return remove_nodes(g, node_id) if kind is None else remove_node_by_kind(g, node_id, kind)


def remove_nodes(g: ProvGraph, *node_ids: str) -> ProvGraph:
    """Without all nodes of these ids and their edges."""
    gone = F.col("node_id").isin(list(node_ids))
    ends = F.col("arg1").isin(list(node_ids)) | F.col("arg2").isin(list(node_ids))
    return g.with_(nodes=g.nodes.filter(~gone), edges=g.edges.filter(~ends), attrs=g.attrs.filter(~((F.col("record_class") == "node") & F.col("record_id").isin(list(node_ids)))))


def remove_nodes_in(g: ProvGraph, ids: DataFrame) -> ProvGraph:
    """The same for a table with a column ``node_id``, of any size."""
    ids = ids.select("node_id").distinct()
    kept = g.edges.join(ids, g.edges.arg1 == ids.node_id, "left_anti").join(ids, F.col("arg2") == ids.node_id, "left_anti")
    own = g.attrs.filter("record_class = 'node'").join(ids, F.col("record_id") == F.col("node_id"), "left_anti")
    return g.with_(nodes=g.nodes.join(ids, "node_id", "left_anti"), edges=kept, attrs=own.unionByName(g.attrs.filter("record_class <> 'node'")))


def remove_node_by_kind(g: ProvGraph, node_id: str, kind: str) -> ProvGraph:
    left = g.nodes.filter(~((F.col("node_id") == node_id) & (F.col("kind") == kind.lower())))
    if left.filter(F.col("node_id") == node_id).isEmpty():
        return remove_nodes(g, node_id)
    return g.with_(nodes=left)


def rename_node(g: ProvGraph, old: str, new: str, keep_edges: bool = True) -> ProvGraph:
    """The node under another id; its relations follow, or are dropped if ``keep_edges`` is false."""
    if old == new:
        return g
    if g.nodes.filter(F.col("node_id") == old).isEmpty():
        raise NodeNotFoundError(old)
    if not g.nodes.filter(F.col("node_id") == new).isEmpty():
        raise InvalidOperationError(f"{new} is in use")
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    ends = (F.col("arg1") == old) | (F.col("arg2") == old)
    edges = g.edges.withColumns({"arg1": swap("arg1"), "arg2": swap("arg2")}) if keep_edges else g.edges.filter(~ends)
    record = F.when((F.col("record_class") == "node") & (F.col("record_id") == old), F.lit(new)).otherwise(F.col("record_id"))
    return g.with_(nodes=g.nodes.withColumn("node_id", swap("node_id")), edges=edges, attrs=g.attrs.withColumn("record_id", record))


def add_edge(g: ProvGraph, relation: str, source: str, target: str, edge_id: str | None = None, attributes: Mapping[str, object] | None = None, bundle_id: str | None = None) -> ProvGraph:
    """A relation between two nodes that exist.

    Arguments go as a caller names them: generation and derivation from what causes to what
    results, all other kinds in formal order.
    """
    name = S.relation_name(relation)
    if name in ("start", "end", "invalidation"):
        raise InvalidOperationError(f"{name} cannot be added as an edge")
    there = g.nodes.filter(F.col("node_id").isin([source, target])).select("node_id").distinct().count()
    if there < len({source, target}):
        raise NodeNotFoundError(f"{source} or {target}")
    arg1, arg2 = (target, source) if name in ("generation", "derivation") else (source, target)
    at = _next_ordinal(g.edges)
    edge_id = edge_id or f"relation_{at}"
    row = g.spark.createDataFrame([(bundle_id, edge_id, name, arg1, arg2, at)], S.EDGES)
    return g.with_(edges=g.edges.unionByName(row), attrs=g.attrs.unionByName(_attr_rows(g, edge_id, "edge", attributes)))


def remove_edges(g: ProvGraph, source: str | None = None, target: str | None = None, relation: str | None = None, edge_id: str | None = None) -> tuple[ProvGraph, int]:
    """Without the doc-view edges that match all that is given; also how many these were."""
    match = F.lit(True)
    view = g.directed
    for column, wanted in (("src", source), ("dst", target), ("edge_id", edge_id)):
        if wanted is not None:
            match &= F.coalesce(F.col(column) == wanted, F.lit(False))
    if relation:
        match &= is_relation(relation)
    n = view.filter(match).count()
    return g.with_(edges=view.filter(~match).select(g.edges.columns)), n


def remove_edge(g: ProvGraph, source: str, target: str, relation: str | None = None) -> tuple[ProvGraph, bool]:
    """Like remove_edges; without a relation the swapped ends are tried if nothing matched."""
    out, n = remove_edges(g, source, target, relation)
    if n == 0 and relation is None:
        out, n = remove_edges(g, target, source)
    return out, n > 0


def repoint(g: ProvGraph, edge_id: str, cause: str, effect: str) -> ProvGraph:
    """Other ends for a relation: usage, generation or derivation."""
    at = F.col("edge_id") == edge_id
    kinds = [r[0] for r in g.edges.filter(at).select("relation").distinct().limit(3).collect()]
    if not kinds:
        raise InvalidOperationError(f"no edge {edge_id}")
    if not set(kinds) <= {"usage", "generation", "derivation"}:
        raise InvalidOperationError(f"cannot re-point {kinds}")
    return g.with_(edges=g.edges.withColumns({"arg1": F.when(at, F.lit(effect)).otherwise(F.col("arg1")), "arg2": F.when(at, F.lit(cause)).otherwise(F.col("arg2"))}))


def repoint_by_kind(g: ProvGraph, relation: str, old_cause: str, old_effect: str, cause: str, effect: str) -> ProvGraph:
    """All wrap-view edges of a kind between two nodes, moved to two others."""
    at = is_relation(relation) & (F.col("arg1") == old_effect) & (F.col("arg2") == old_cause)
    return g.with_(edges=g.edges.withColumns({"arg1": F.when(at, F.lit(effect)).otherwise(F.col("arg1")), "arg2": F.when(at, F.lit(cause)).otherwise(F.col("arg2"))}))


def set_collection_members(g: ProvGraph, collection: str, members: list[str], check: bool = False) -> ProvGraph:
    """The collection's membership replaced; members that are no nodes are skipped, or raise with ``check``."""
    wanted = g.spark.createDataFrame([(m, k) for k, m in enumerate(dict.fromkeys(members))], "arg2 string, k long")
    known = wanted.join(g.nodes.select(F.col("node_id").alias("arg2")).distinct(), "arg2", "left_semi")
    if check and known.count() < len(set(members)):
        raise NodeNotFoundError(f"members of {collection}")
    old = is_relation("membership") & (F.col("arg1") == collection)
    at = _next_ordinal(g.edges)
    rows = known.select(F.lit(None).cast("string").alias("bundle_id"), F.concat(F.lit("relation_"), F.lit(at) + F.col("k")).alias("edge_id"), F.lit("membership").alias("relation"), F.lit(collection).alias("arg1"), "arg2", (F.lit(at) + F.col("k")).alias("ordinal"))
    return g.with_(edges=g.edges.filter(~old).unionByName(rows))


def set_bundle_id(g: ProvGraph, bundle_id: str) -> ProvGraph:
    return g.with_(nodes=g.nodes.withColumn("bundle_id", F.lit(bundle_id)), edges=g.edges.withColumn("bundle_id", F.lit(bundle_id)), bundles=g.spark.createDataFrame([(bundle_id,)], S.BUNDLES))


def add_activity(g: ProvGraph, activity: str, used: Iterable[str] = (), generated: Iterable[str] = (), **options) -> ProvGraph:
    """An activity with its usages and generations."""
    g = add_node(g, "activity", activity, **options)
    for e in used:
        g = add_edge(g, "usage", activity, e)
    for e in generated:
        g = add_edge(g, "generation", activity, e)
    return g


def merge_duplicates(g: ProvGraph) -> ProvGraph:
    """One record per node id: the first record by arrival, its types first, then those of all others.

    Records that arrive together go by their columns. Only distinct lists of types are gathered,
    so an id may have any number of records.
    """
    own = ("bundle_id", "kind", "start_time", "end_time", "types")
    by = g.nodes.groupBy("node_id").agg(
        F.min_by(F.struct(*own), F.struct("ordinal", *own)).alias("x"), F.collect_set("types").alias("all"),
        F.min("is_placeholder").alias("is_placeholder"), F.min("ordinal").alias("ordinal"),
    )
    by = by.select("node_id", *[f"x.{c}" for c in own[:-1]], F.array_distinct(F.concat("x.types", F.flatten(F.array_sort("all")))).alias("types"), "is_placeholder", "ordinal")
    return g.with_(nodes=by.select(g.nodes.columns), attrs=g.attrs.dropDuplicates(["record_id", "record_class", "name", "value", "value_type"]))


def clear(g: ProvGraph) -> ProvGraph:
    return g.with_(nodes=g.nodes.limit(0), edges=g.edges.limit(0), attrs=g.attrs.limit(0), bundles=g.bundles.limit(0))
