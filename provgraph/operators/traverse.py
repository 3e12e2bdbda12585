"""Traversal: closures, paths, components, connector chains, subgraphs.

All of it takes a view (``doc`` or ``wrap``), skips self-loops, and follows edges breadth first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import has_type, is_relation, is_traversal
from ..graph import ProvGraph
from ..plans import fixpoint, tiles
from ..plans.scratch import materialize


def _steps(g: ProvGraph, relations: Iterable[str] | None, view: str) -> DataFrame:
    e = g.view(view)
    return (e.filter(is_relation(*relations)) if relations else e).select("src", "dst")


def _reversed(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _starts(g: ProvGraph, node_id: str | Iterable[str] | DataFrame | None) -> DataFrame | None:
    if node_id is None or isinstance(node_id, DataFrame):
        return node_id
    ids = [node_id] if isinstance(node_id, str) else list(node_id)
    return g.spark.createDataFrame([(i,) for i in ids], "node string")


def successors(g: ProvGraph, node_id: str | Iterable[str] | DataFrame | None = None, relations: Iterable[str] | None = None, max_depth: int | None = None, view: str = "doc") -> DataFrame:
    """(start, node, depth) reached forwards from one, several (a table with ``node``) or all nodes."""
    return fixpoint.reach(_steps(g, relations, view), _starts(g, node_id), max_depth)


def successor_counts(g: ProvGraph, relations: Iterable[str] | None = None, view: str = "doc", itself: bool = True) -> DataFrame:
    """(start, n_reached, farthest, total): what ``successors`` of all nodes has per start, counted."""
    return fixpoint.reach_counts(_steps(g, relations, view), itself)


def predecessors(g: ProvGraph, node_id: str | Iterable[str] | DataFrame | None = None, relations: Iterable[str] | None = None, max_depth: int | None = None, view: str = "doc") -> DataFrame:
    """(start, node, depth) reached backwards."""
    return fixpoint.reach(_reversed(_steps(g, relations, view)), _starts(g, node_id), max_depth)


def connected_components(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, component): weakly connected; an isolated node is its own component."""
    found = fixpoint.components(g.nodes.select(F.col("node_id").alias("node")), g.view(view).select("src", "dst"))
    return found.withColumnRenamed("node", "node_id")


def find_paths(g: ProvGraph, pairs: DataFrame, max_nodes: int | None = None, relations: Iterable[str] | None = None, view: str = "doc") -> DataFrame:
    """(source, target, path): all simple paths for the rows (source, target) of ``pairs``.

    ``max_nodes`` counts nodes; None or 0 is no bound. Equal ends give the path of that one node.
    Walks are cut to nodes that can still reach the target.
    """
    e = materialize(_steps(g, relations, view).filter("src <> dst"), "path-edges")  # parallel edges go when few are left
    pairs = materialize(pairs.select("source", "target").distinct(), "path-pairs")
    ends = pairs.select(F.col("target").alias("node")).distinct()
    able = fixpoint.reach_written(_reversed(e), ends, max(1, max_nodes - 1) if max_nodes else None).select(F.col("start").alias("goal"), F.col("node").alias("via"))
    able = materialize(able.union(ends.select("node", "node")).distinct(), "path-able")
    via = able.select("via").distinct()
    e = materialize(e.join(via, e.dst == via.via, "left_semi").join(via, e.src == via.via, "left_semi").distinct(), "path-edges")
    walk = pairs.select("source", "target", F.array("source").alias("path"), F.col("source").alias("at"))
    done, length = pairs.filter("source = target").select("source", "target", F.array("source").alias("path")), 1
    walk = walk.filter("source <> target")
    while not max_nodes or length < max_nodes:
        length += 1
        step = walk.join(e, walk.at == e.src).filter(~F.array_contains("path", F.col("dst")))
        step = step.join(able, (F.col("goal") == F.col("target")) & (F.col("via") == F.col("dst")), "left_semi")
        walk = materialize(step.select("source", "target", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")), "path-walk")
        if walk.isEmpty():
            break
        done = done.unionByName(walk.filter("at = target").drop("at"))
        walk = walk.filter("at <> target")
    return done


def _hops(g: ProvGraph, view: str) -> DataFrame:
    """Distinct (src, dst) along either direction, without loops."""
    e = g.view(view).select("src", "dst")
    return materialize(e.union(_reversed(e)).filter("src <> dst").distinct(), "undirected-hops")


def _half_ways(hops: DataFrame, ends: DataFrame, end: str, longest: int) -> list[DataFrame]:
    """(end, end_at, end_path) of simple ways of 0 to ``longest`` edges from the distinct values of the column ``end``."""
    out = [ends.select(end).distinct().select(end, F.col(end).alias("at"), F.array(end).alias("path"))]
    for k in range(longest):
        step = out[-1].join(hops, F.col("at") == hops.src).filter(~F.array_contains("path", F.col("dst")))
        out.append(materialize(step.select(end, F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")), f"{end}-ways-{k + 1}"))
    return [w.select(end, F.col("at").alias(f"{end}_at"), F.col("path").alias(f"{end}_path")) for w in out]


def _with_ways(rows: DataFrame, end: str, ways: list[DataFrame], length: int) -> DataFrame:
    """Rows with ``end`` get the ways of one length that go out from it."""
    return rows.join(ways[length], end) if length else rows.withColumns({f"{end}_at": F.col(end), f"{end}_path": F.array(end)})


def undirected_paths(g: ProvGraph, pairs: DataFrame, max_depth: int = 3, view: str = "wrap") -> DataFrame:
    """Simple paths of at most ``max_depth`` edges along either direction.

    Half ways go out from the distinct sources and targets, whatever the number of pairs; a pair joins
    one of each over the edge between their ends.
    """
    hops = _hops(g, view)
    done = pairs.filter("source = target").select("source", "target", F.array("source").alias("path"))
    pairs = pairs.filter("source <> target").select("source", "target")
    there, back = _half_ways(hops, pairs, "source", max_depth // 2), _half_ways(hops, pairs, "target", max(0, max_depth - 1) // 2)
    for n in range(1, max_depth + 1):
        rows = _with_ways(_with_ways(pairs, "source", there, n // 2), "target", back, (n - 1) // 2)
        rows = rows.filter("source_at <> target_at").join(hops, (F.col("source_at") == hops.src) & (F.col("target_at") == hops.dst))
        path = F.concat("source_path", F.reverse("target_path"))
        done = done.unionByName(rows.select("source", "target", path.alias("path")).filter(F.size(F.array_distinct("path")) == n + 1))
    return done


def undirected_paths_in_groups(g: ProvGraph, sources: DataFrame, targets: DataFrame, max_depth: int = 3, view: str = "wrap", sep: str | None = None) -> DataFrame:
    """``undirected_paths`` from each row (source, group) to each row (target, group) of the same group.

    The pairs are not listed: half ways meet over the edges between their ends, and only what is a path is made, by
    the tasks that return it. With ``sep`` a path is text, of halves that are joined before they meet.
    """
    hops = _hops(g, view)
    sources, targets = sources.select("source", "group"), targets.select("target", "group")
    whole = (lambda path: path) if sep is None else (lambda path: F.array_join(path, sep))
    same = sources.join(targets, (F.col("source") == F.col("target")) & (sources.group == targets.group))
    done = same.select("source", "target", whole(F.array("source")).alias("path"))
    there, back = _half_ways(hops, sources, "source", max_depth // 2), _half_ways(hops, targets, "target", max(0, max_depth - 1) // 2)
    for n in range(1, max_depth + 1):
        heads, tails = _with_ways(sources, "source", there, n // 2), _with_ways(targets, "target", back, (n - 1) // 2)
        wanted = heads.select("group", F.col("source_at").alias("src")).distinct().join(hops, "src")
        links = materialize(wanted.join(tails.select("group", F.col("target_at").alias("dst")).distinct(), ["group", "dst"], "left_semi").select("group", "src", "dst"), f"undirected-links-{n}")
        if links.isEmpty():
            continue
        heads = heads.select("group", F.col("source_at").alias("at"), "source", whole(F.col("source_path")).alias("head"), *["source_path"] * (n > 2))
        tails = tails.withColumnRenamed("target_at", "dst").join(links, ["group", "dst"])
        tails = tails.select("group", F.col("src").alias("at"), "target", whole(F.reverse("target_path")).alias("tail"), *["target_path"] * (n > 2))
        rows = tiles.meet(heads, tails, ["group", "at"])
        rows = rows.filter(~F.arrays_overlap("source_path", "target_path") if n > 2 else F.col("source") != F.col("target"))
        done = done.unionByName(rows.select("source", "target", F.concat("head", *[F.lit(sep)] * (sep is not None), "tail").alias("path")))
    return done


def _connectors(g: ProvGraph) -> DataFrame:
    return g.nodes.filter(is_traversal() & (has_type("ForwardConnector") | has_type("BackwardConnector"))).select(F.col("node_id").alias("node"))


def _connector_edges(g: ProvGraph) -> DataFrame:
    e, c = g.view("doc").filter(is_relation("derivation")).select("src", "dst"), _connectors(g)
    return e.join(c, F.col("src") == c.node, "left_semi").join(c, F.col("dst") == c.node, "left_semi")


def precursors(g: ProvGraph, connector_id: str | None = None) -> DataFrame:
    """(start, node, depth): connectors derived from a connector, over derivations between connectors.

    Nothing is returned for a node that is no connector.
    """
    return fixpoint.reach(_reversed(_connector_edges(g)), _starts(g, connector_id))


def successor_connectors(g: ProvGraph, connector_id: str | None = None) -> DataFrame:
    """(start, node, depth): connectors that a connector was derived from."""
    return fixpoint.reach(_connector_edges(g), _starts(g, connector_id))


def related_connectors(g: ProvGraph, connector_id: str | None = None, direction: str = "both") -> DataFrame:
    """Closure over connectors in the doc view: ``forward``, ``backward``, or ``both`` mixed."""
    e = _connector_edges(g)
    e = {"forward": e, "backward": _reversed(e), "both": e.union(_reversed(e))}[direction]
    return fixpoint.reach(e, _starts(g, connector_id))


def subgraph(g: ProvGraph, ids: Iterable[str] | DataFrame, relations: Iterable[str] | None = None) -> ProvGraph:
    """Induced on ids (a list, or a table with ``node_id``): nodes, edges between them, attributes.

    ``relations`` narrows the edges, e.g. to usage and generation.
    """
    ids = ids if isinstance(ids, DataFrame) else g.spark.createDataFrame([(i,) for i in ids], "node_id string")
    ids = ids.select("node_id").distinct()
    e = g.edges.filter(is_relation(*relations)) if relations else g.edges
    for arg in ("arg1", "arg2"):
        e = e.join(ids, F.col(arg) == ids.node_id, "left_semi")
    own = g.attrs.filter("record_class = 'node'").join(ids, F.col("record_id") == ids.node_id, "left_semi")
    rel = g.attrs.filter("record_class = 'edge'").join(e.select("edge_id").distinct(), F.col("record_id") == F.col("edge_id"), "left_semi")
    return g.with_(nodes=g.nodes.join(ids, "node_id", "left_semi"), edges=e, attrs=own.unionByName(rel))


def subgraph_where(g: ProvGraph, condition: Column) -> ProvGraph:
    """Induced on the nodes that meet a condition on node columns."""
    return subgraph(g, g.nodes.filter(condition).select("node_id"))


def traversal_part(g: ProvGraph) -> ProvGraph:
    return subgraph_where(g, is_traversal())


def derivation_chains(g: ProvGraph) -> DataFrame:
    """(node_id, last, length): from every entity along derivations, as long as it stays on entities;
    length counts nodes.

    In the doc view, a step goes from a node to the source of the first derivation (by arrival)
    that points at it.
    """
    e = g.view("doc").filter(is_relation("derivation"))
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("dst").orderBy("ordinal", "src"))).filter("n = 1")
    entity = g.nodes.filter("kind = 'entity'").select("node_id")
    parents = first.select(F.col("dst").alias("node"), F.col("src").alias("parent"))
    for c in ("node", "parent"):
        parents = parents.join(entity, F.col(c) == entity.node_id, "left_semi")
    walked = fixpoint.chase(materialize(parents.filter("node <> parent"), "chain-parents"))
    found = walked.select(F.col("node").alias("_n"), "last", "steps")
    return entity.join(found, F.col("node_id") == F.col("_n"), "left").select("node_id", F.coalesce("last", "node_id").alias("last"), (F.coalesce("steps", F.lit(0)) + 1).alias("length"))


def strong_components(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, component) by colouring: the largest id that reaches a node, then backwards from it.

    Nodes without a predecessor or successor left are components of their own and are peeled first.
    """
    edges = materialize(g.adjacency(view), "scc-edges")
    out = None
    while not edges.isEmpty():
        sources, sinks = edges.select(F.col("src").alias("n")).distinct(), edges.select(F.col("dst").alias("n")).distinct()
        inner = sources.intersect(sinks)
        cut = edges.join(inner, F.col("src") == inner.n, "left_semi").join(inner, F.col("dst") == inner.n, "left_semi")
        cut = materialize(cut, "scc-edges")
        if cut.count() < edges.count():
            edges = cut
            continue
        colour = materialize(edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().withColumn("colour", F.col("n")), "scc-colour")
        while True:
            sent = edges.join(colour, F.col("src") == colour.n).groupBy(F.col("dst").alias("n")).agg(F.max("colour").alias("new"))
            moved = materialize(colour.join(sent, "n", "left").select("n", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("up")), "scc-colour")
            colour = moved.drop("up")
            if moved.filter("up").isEmpty():
                break
        c1, c2 = colour.select(F.col("n").alias("src"), F.col("colour").alias("a")), colour.select(F.col("n").alias("dst"), F.col("colour").alias("b"))
        same = edges.join(c1, "src").join(c2, "dst").filter("a = b").select("src", "dst")
        roots = colour.filter("n = colour").select(F.col("n").alias("node"))
        back = fixpoint.reach(_reversed(same), roots).select(F.col("node").alias("node_id"), F.col("start").alias("component"))
        found = materialize(back.union(roots.select("node", "node")).distinct(), "scc-found")
        out = found if out is None else out.unionByName(found)
        edges = materialize(edges.join(found.select(F.col("node_id").alias("src")), "src", "left_anti").join(found.select(F.col("node_id").alias("dst")), "dst", "left_anti"), "scc-edges")
    alone = g.nodes.select("node_id")
    if out is None:
        return alone.withColumn("component", F.col("node_id"))
    out = out.withColumnRenamed("node_id", "_n")
    return alone.join(out, F.col("node_id") == F.col("_n"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def circular_groups(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(component, n_nodes, n_pairs): groups of mutually reachable nodes; pairs are counted, not listed."""
    by = strong_components(g, view).groupBy("component").agg(F.count("*").alias("n_nodes")).filter("n_nodes > 1")
    return by.withColumn("n_pairs", (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2).cast("long"))


def circular_dependencies(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(a, b) with a < b and paths both ways: the output itself grows with the square of a cycle's size."""
    c = strong_components(g, view)
    return c.select(F.col("node_id").alias("a"), "component").join(c.select(F.col("node_id").alias("b"), "component"), "component").filter("a < b").select("a", "b")


def influence_network(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, influences): the one-hop successors of every node, sorted."""
    out = g.adjacency(view).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("influences"))
    return g.nodes.select("node_id").join(out, F.col("node_id") == F.col("src"), "left").select("node_id", F.coalesce("influences", F.array().cast("array<string>")).alias("influences"))


def critical_paths(g: ProvGraph, view: str = "doc", max_nodes: int | None = None) -> DataFrame:
    """(source, path): the longest simple paths from each main activity to a node without successor."""
    e = materialize(g.adjacency(view), "critical-edges")
    mains = g.nodes.filter(has_type("MainActivity")).select(F.col("node_id").alias("source"))
    walk = materialize(mains.select("source", F.array("source").alias("path"), F.col("source").alias("at")), "critical-walk")
    done, length = None, 1
    while True:
        ahead = walk.join(e, walk.at == e.src, "left").withColumn("goes", F.col("dst").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False)))
        if max_nodes and length >= max_nodes:
            ahead = ahead.withColumn("goes", F.lit(False))
        ahead = materialize(ahead.select("source", "path", "at", "dst", "goes"), "critical-ahead")
        moving = ahead.filter("goes")
        leaf = ahead.filter("dst IS NULL").select("source", "path")
        done = leaf if done is None else done.unionByName(leaf)
        if moving.isEmpty():
            break
        walk = moving.select("source", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        length += 1
    best = Window.partitionBy("source").orderBy(F.size("path").desc())
    return done.withColumn("r", F.rank().over(best)).filter("r = 1").select("source", "path")


def distances(g: ProvGraph, node_id: str | Iterable[str] | DataFrame | None = None, view: str = "doc") -> DataFrame:
    """(start, node, depth): least number of steps; a start's distance to itself (0) is not listed."""
    return successors(g, node_id, view=view).filter("start <> node")
