"""Clone, merge, filter by time, compare."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import ProvGraph
from . import edit, metrics


def clone(g: ProvGraph) -> ProvGraph:
    """The tables are immutable, so a copy is the handle itself."""
    return g.with_()


def merge_documents(a: ProvGraph, b: ProvGraph, policy: str = "keep_first", nodes_only: bool = False) -> ProvGraph:
    """Nodes of both; of an id in both, ``keep_first`` and ``keep_both`` take a's record, ``keep_second`` b's.

    Attributes go with the record that stays. Edges of both stay, equal ones once; ``nodes_only``
    leaves b's edges out and drops the types of b's nodes.
    """
    if policy not in ("keep_first", "keep_second", "keep_both"):
        raise ValueError(policy)
    own, other = (0, 1) if policy != "keep_second" else (1, 0)
    theirs = b.nodes.withColumn("types", F.array().cast(f"array<{S.TYPE}>")) if nodes_only else b.nodes
    both = a.nodes.withColumn("_r", F.lit(own)).unionByName(theirs.withColumn("_r", F.lit(other)))
    # a placeholder never stands in for a declared record
    first = Window.partitionBy("node_id").orderBy("is_placeholder", "_r", "ordinal")
    kept = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    mine = kept.select(F.col("node_id").alias("record_id"), "_r")
    attrs = a.attrs.withColumn("_r", F.lit(own)).unionByName(b.attrs.withColumn("_r", F.lit(other)))
    node_attrs = attrs.filter("record_class = 'node'").join(mine, ["record_id", "_r"], "left_semi").drop("_r")
    edges = a.edges if nodes_only else _distinct_edges(a.edges.unionByName(b.edges))
    edge_attrs = (a.attrs if nodes_only else attrs.drop("_r")).filter("record_class <> 'node'").distinct()
    return a.with_(nodes=kept.drop("_r"), edges=edges, attrs=node_attrs.select(a.attrs.columns).unionByName(edge_attrs), namespaces=a.namespaces.unionByName(b.namespaces).dropDuplicates(["prefix"]), bundles=a.bundles.union(b.bundles).distinct())


def _distinct_edges(edges: DataFrame) -> DataFrame:
    same = Window.partitionBy("bundle_id", "edge_id", "relation", "arg1", "arg2").orderBy("ordinal")
    return edges.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")


def merge_graphs(*graphs: ProvGraph, bundle_id: str = "ex:bundle") -> ProvGraph:
    """Nodes by id with types and attributes united; edges side by side, one per explicit id; one bundle."""
    first = graphs[0]
    nodes, edges, attrs, names = first.nodes, first.edges, first.attrs, first.namespaces
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes), edges.unionByName(g.edges)
        attrs, names = attrs.unionByName(g.attrs), names.unionByName(g.namespaces)
    named = Window.partitionBy("edge_id").orderBy("ordinal")
    edges = edges.withColumn("_n", F.when(F.col("edge_id").isNull() | F.col("edge_id").startswith("relation_"), F.lit(1)).otherwise(F.row_number().over(named))).filter("_n = 1").drop("_n")
    united = edit.merge_duplicates(first.with_(nodes=nodes, edges=edges, attrs=attrs, namespaces=names.dropDuplicates(["prefix"])))
    return edit.set_bundle_id(united, bundle_id)


def union_graphs(*graphs: ProvGraph) -> ProvGraph:
    """All records of all graphs, each in its own bundle; the first record of an id wins."""
    out = graphs[0]
    for g in graphs[1:]:
        out = merge_documents(out, g)
    return out


def divide(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """(src, dst, n_relations, relations): one row per relation record, as edges are stored."""
    return g.view(view).select("src", "dst", F.lit(1).cast("long").alias("n_relations"), F.array("relation").alias("relations"))


def merge_edges(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """(src, dst, n_relations, relations): edges between the same nodes grouped into one."""
    return g.view(view).groupBy("src", "dst").agg(F.count("*").alias("n_relations"), F.sort_array(F.collect_set("relation")).alias("relations"))


#: Ways to make edges from relation records, by name; the first is the default.
GROUPINGS = {"merged": merge_edges, "divided": divide}


def register_grouping(name: str, make: Callable[[ProvGraph, str], DataFrame], default: bool = False) -> None:
    """A way of one's own: a function of a graph and a view that gives columns like ``merge_edges``."""
    others = {k: v for k, v in GROUPINGS.items() if k != name}
    GROUPINGS.clear()
    GROUPINGS.update({name: make} | others if default else others | {name: make})


def grouped_edges(g: ProvGraph, mode: str | None = None, view: str = "wrap") -> DataFrame:
    """The edges of a view in a registered grouping; without a name in the default one."""
    name = mode or next(iter(GROUPINGS))
    if name not in GROUPINGS:
        raise ValueError(f"unknown grouping {name!r}")
    return GROUPINGS[name](g, view)


def filter_by_time(g: ProvGraph, start: str | None = None, end: str | None = None, keep_edges: bool = True) -> ProvGraph:
    """Without activities that start before ``start`` or end after ``end``; unknown times stay.

    Edges between the nodes that stay are kept, or all dropped if ``keep_edges`` is false.
    """
    ok = F.lit(True)
    if start is not None:
        ok &= F.coalesce(F.col("start_time") >= F.lit(start).cast("timestamp"), F.lit(True))
    if end is not None:
        ok &= F.coalesce(F.col("end_time") <= F.lit(end).cast("timestamp"), F.lit(True))
    out = edit.remove_nodes_in(g, g.nodes.filter((F.col("kind") == "activity") & ~ok))
    return out if keep_edges else out.with_(edges=out.edges.limit(0))


def _six(g: ProvGraph) -> tuple:
    row = metrics.statistics(g).first()
    bundle = g.bundles.agg(F.min("bundle_id")).first()[0]
    return (bundle, row.total_nodes, row.entities, row.activities, row.agents, row.total_edges)


def equal_counts(a: ProvGraph, b: ProvGraph) -> bool:
    """Same bundle id and the same numbers of nodes, entities, activities, agents and edges."""
    return _six(a) == _six(b)


def difference(a: ProvGraph, b: ProvGraph) -> DataFrame:
    """(side, record_class, id): declared nodes and edges of one graph that the other lacks."""
    n = lambda g: g.nodes.select(F.lit("node").alias("record_class"), F.concat_ws(" ", "node_id", "kind").alias("id"))
    e = lambda g: g.edges.select(F.lit("edge").alias("record_class"), F.concat_ws(" ", "relation", "arg1", "arg2").alias("id"))
    signed = [rows(g).withColumn("n", F.lit(sign)) for g, sign in ((a, 1), (b, -1)) for rows in (n, e)]
    over = reduce(DataFrame.unionByName, signed).groupBy("record_class", "id").agg(F.sum("n").alias("n")).filter("n <> 0")
    # a row for each record that the other graph lacks
    side = F.when(F.col("n") > 0, F.lit("first")).otherwise(F.lit("second"))
    return over.select(side.alias("side"), "record_class", "id", F.explode(F.array_repeat(F.lit(0), F.abs("n").cast("int")))).drop("col")


def equal_content(a: ProvGraph, b: ProvGraph) -> bool:
    return difference(a, b).isEmpty()


def stable_hash(g: ProvGraph) -> DataFrame:
    """One row: a hash of the six values that ``equal_counts`` compares, alike in every process."""
    s = metrics.statistics(g).select("total_nodes", "entities", "activities", "agents", "total_edges")
    b = g.bundles.agg(F.min("bundle_id").alias("bundle_id"))
    return b.join(s).select(F.md5(F.concat_ws("|", F.coalesce("bundle_id", F.lit("")), "total_nodes", "entities", "activities", "agents", "total_edges")).alias("hash"))
