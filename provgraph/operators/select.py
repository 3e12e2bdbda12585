"""Selection of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import MultipleEdgesError, MultipleNodesError
from ..functions.types import has_exact_type, has_type, has_type_or_kind, is_relation, is_traversal, prov_kind
from ..graph import ProvGraph


def one(rows: DataFrame, error: type[Exception], what: str) -> Row | None:
    """The only row, None without one; more than one raises. Fetches two rows at most."""
    found = rows.limit(2).collect()
    if len(found) > 1:
        raise error(f"more than one match for {what}")
    return found[0] if found else None


# --- nodes -----------------------------------------------------------------------------------


def nodes_by_id(g: ProvGraph, node_id: str) -> DataFrame:
    return g.nodes.filter(F.col("node_id") == node_id)


def node(g: ProvGraph, node_id: str) -> Row | None:
    return one(nodes_by_id(g, node_id), MultipleNodesError, node_id)


def nodes_by_type(g: ProvGraph, name: str) -> DataFrame:
    """By full or local type name in any case, or by record kind."""
    return g.nodes.filter(has_type_or_kind(name))


def nodes_by_exact_type(g: ProvGraph, uri: str) -> DataFrame:
    return g.nodes.filter(has_exact_type(uri))


def nodes_by_attribute(g: ProvGraph, name: str, value: str | None = None) -> DataFrame:
    """Nodes that have the attribute, with the value if one is given."""
    match = (F.col("record_class") == "node") & (F.col("name") == name)
    if value is not None:
        match &= F.col("value") == value
    owners = g.attrs.filter(match).select(F.col("record_id").alias("node_id"))
    return g.nodes.join(owners, "node_id", "left_semi")


def nodes_map(g: ProvGraph) -> DataFrame:
    """(node_id, records): every record under its id."""
    return g.nodes.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "bundle_id", "kind"))).alias("records"))


def nodes_by_element(g: ProvGraph, node_id: str, kind: str, bundle_id: str | None = None) -> DataFrame:
    """By equality of the record: id, kind and bundle."""
    return g.nodes.filter((F.col("node_id") == node_id) & (F.col("kind") == kind) & F.col("bundle_id").eqNullSafe(F.lit(bundle_id)))


def nodes_by_id_and_kind(g: ProvGraph, node_id: str, kind: str) -> DataFrame:
    return g.nodes.filter((F.col("node_id") == node_id) & (F.col("kind") == kind.lower()))


def _traversal_nodes(g: ProvGraph, name: str) -> DataFrame:
    return g.nodes.filter(has_type(name) & is_traversal())


def main_activities(g: ProvGraph) -> DataFrame:
    return _traversal_nodes(g, "MainActivity")


def main_activity(g: ProvGraph) -> DataFrame:
    """The first main activity by arrival, as a table of at most one row."""
    return main_activities(g).orderBy("ordinal").limit(1)


def forward_connectors(g: ProvGraph) -> DataFrame:
    return _traversal_nodes(g, "ForwardConnector")


def backward_connectors(g: ProvGraph) -> DataFrame:
    return _traversal_nodes(g, "BackwardConnector")


def current_agents(g: ProvGraph) -> DataFrame:
    return _traversal_nodes(g, "CurrentAgent")


def traversal_nodes(g: ProvGraph) -> DataFrame:
    return g.nodes.filter(is_traversal())


def domain_nodes(g: ProvGraph) -> DataFrame:
    return g.nodes.filter(~is_traversal())


def attribute_values(g: ProvGraph, node_id: str, name: str) -> DataFrame:
    match = (F.col("record_class") == "node") & (F.col("record_id") == node_id) & (F.col("name") == name)
    return g.attrs.filter(match).orderBy("ordinal").select("value", "value_type")


def node_kinds(g: ProvGraph) -> DataFrame:
    """(node_id, kind, type_name): type_name is the first local type, else the kind."""
    return g.nodes.select("node_id", "kind", F.coalesce(F.get(F.col("types"), F.lit(0))["local"], "kind").alias("type_name"))


def incident_edges(g: ProvGraph, node_id: str, side: str = "any", relation: str | None = None) -> DataFrame:
    """Wrap-view edges at a node: ``side`` is any, cause (it is the cause) or effect."""
    e = g.directed
    at = {"any": (F.col("cause") == node_id) | (F.col("effect") == node_id), "cause": F.col("cause") == node_id, "effect": F.col("effect") == node_id}[side]
    return e.filter(at & is_relation(relation)) if relation else e.filter(at)


def connected_nodes(g: ProvGraph, node_id: str, relations: list[str] | None = None) -> DataFrame:
    """Undirected neighbours, the node itself excluded."""
    e = incident_edges(g, node_id)
    if relations:
        e = e.filter(is_relation(*relations))
    return e.select(F.when(F.col("cause") == node_id, F.col("effect")).otherwise(F.col("cause")).alias("node_id")).filter(F.col("node_id") != node_id).distinct()


def node_degrees(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """(node_id, in_degree, out_degree, degree) over all edges, parallel ones included, for every node."""
    e = g.view(view)
    ends = e.select(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("src", F.lit(0), F.lit(1)))
    by = ends.groupBy("n").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return g.nodes.select("node_id").join(by, F.col("node_id") == F.col("n"), "left").select("node_id", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("degree"))


def isolated_nodes(g: ProvGraph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("arg1", "arg2")).alias("node_id"))
    return g.nodes.join(ends, "node_id", "left_anti")


def neighbours(g: ProvGraph, node_id: str, direction: str = "both", view: str = "wrap") -> DataFrame:
    """One hop along distinct edges: out (successors), in (predecessors) or both."""
    e = g.view(view)
    out, into = e.filter(F.col("src") == node_id).select(F.col("dst").alias("node_id")), e.filter(F.col("dst") == node_id).select(F.col("src").alias("node_id"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


# --- edges -----------------------------------------------------------------------------------


def edges(g: ProvGraph, source: str | None = None, target: str | None = None, relation: str | None = None) -> DataFrame:
    """Doc-view edges by any of source, target and relation (kind, PROV verb or alias)."""
    e = g.view("doc")
    if source is not None:
        e = e.filter(F.col("src") == source)
    if target is not None:
        e = e.filter(F.col("dst") == target)
    return e.filter(is_relation(relation)) if relation else e


def edge(g: ProvGraph, source: str, target: str, relation: str | None = None) -> Row | None:
    """The only such edge; without a relation the swapped ends are tried too."""
    found = one(edges(g, source, target, relation), MultipleEdgesError, f"{source} -> {target}")
    if found is None and relation is None:
        found = one(edges(g, target, source), MultipleEdgesError, f"{target} -> {source}")
    return found


def edges_by_id(g: ProvGraph, edge_id: str) -> DataFrame:
    """Edges only, never node records of the same id."""
    return g.edges.filter(F.col("edge_id") == edge_id)


def edge_with_kind(g: ProvGraph, edge_id: str, kind: str | None = None) -> DataFrame:
    found = edges_by_id(g, edge_id)
    return found.filter(is_relation(kind)) if kind else found


def edges_by_relation(g: ProvGraph, relation: str, arg1: str, arg2: str) -> DataFrame:
    """Edges that hold this relation between these formal arguments."""
    return g.edges.filter(is_relation(relation) & (F.col("arg1") == arg1) & (F.col("arg2") == arg2))


def edges_where(g: ProvGraph, cause: str | None = None, effect: str | None = None, kind: str | None = None, node_id: str | None = None, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """Wrap-view edges by cause, effect, kind, either end, or an attribute."""
    e = g.directed
    for column, wanted in (("cause", cause), ("effect", effect)):
        if wanted is not None:
            e = e.filter(F.col(column) == wanted)
    if kind:
        e = e.filter(is_relation(kind))
    if node_id is not None:
        e = e.filter((F.col("cause") == node_id) | (F.col("effect") == node_id))
    if attribute is not None:
        own = g.attrs.filter((F.col("record_class") == "edge") & (F.col("name") == attribute))
        own = own if value is None else own.filter(F.col("value") == value)
        e = e.join(own.select(F.col("record_id").alias("edge_id")), "edge_id", "left_semi")
    return e


def other_node(node_id: str) -> Column:
    """The other end of a wrap-view edge, null where the node is not an end."""
    return F.when(F.col("cause") == node_id, F.col("effect")).when(F.col("effect") == node_id, F.col("cause"))


def edge_kinds(g: ProvGraph) -> DataFrame:
    return g.directed.select("edge_id", prov_kind().alias("kind"), "cause", "effect")


def reversed_edges(g: ProvGraph, view: str = "wrap") -> DataFrame:
    e = g.view(view)
    swapped = {"src": "dst", "dst": "src"}
    return e.select(*[F.col(swapped.get(c, c)).alias(c) for c in e.columns])


def unmapped_edges(g: ProvGraph) -> DataFrame:
    """Edges with an end that no declared node has (placeholders do not count as declared)."""
    known = g.nodes.filter("NOT is_placeholder").select("node_id")
    left = [g.edges.join(known, F.col(a) == F.col("node_id"), "left_anti") for a in ("arg1", "arg2")]
    return left[0].unionByName(left[1]).dropDuplicates(["edge_id", "relation", "arg1", "arg2", "ordinal"])


def are_all_relations_mapped(g: ProvGraph) -> bool:
    return unmapped_edges(g).isEmpty()


def _with_ends(e: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for end in ("src", "dst"):
        e = e.join(nodes.select(F.col("node_id").alias(f"_{end}"), *[F.col(c).alias(f"{end}_{c}") for c in columns]), F.col(end) == F.col(f"_{end}")).drop(f"_{end}")
    return e


def cross_part_edges(g: ProvGraph) -> DataFrame:
    """Doc-view edges between traversal information and domain nodes."""
    marked = g.nodes.withColumn("is_ti", is_traversal())
    return _with_ends(g.view("doc"), marked, "is_ti").filter("src_is_ti <> dst_is_ti")


def cross_bundle_edges(g: ProvGraph) -> DataFrame:
    """Wrap-view edges whose ends are declared in different bundles."""
    return _with_ends(g.view("wrap"), g.nodes, "bundle_id").filter("src_bundle_id <> dst_bundle_id").select("edge_id", "relation", F.col("src").alias("cause"), F.col("dst").alias("effect"), F.col("src_bundle_id").alias("cause_bundle"), F.col("dst_bundle_id").alias("effect_bundle"))


def traversal_information(g: ProvGraph) -> DataFrame:
    """Wrap-view edges with cross_part (different bundles) and the cost of a step."""
    from ..functions.types import traversal_cost

    both = _with_ends(g.view("wrap"), g.nodes, "bundle_id")
    cross = F.coalesce(F.col("src_bundle_id") != F.col("dst_bundle_id"), F.lit(False))
    return both.withColumn("cross_part", cross).withColumn("cost", traversal_cost(F.col("relation"), F.col("cross_part"))).select("edge_id", "relation", F.col("src").alias("cause"), F.col("dst").alias("effect"), "cross_part", "cost")


def edge_attributes(g: ProvGraph, edge_id: str, name: str | None = None) -> DataFrame:
    own = g.attrs.filter((F.col("record_class") == "edge") & (F.col("record_id") == edge_id))
    return own.filter(F.col("name") == name) if name else own
