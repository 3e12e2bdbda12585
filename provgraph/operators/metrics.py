"""Aggregations and graph metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import has_type, is_traversal, prov_kind
from ..graph import ProvGraph
from ..plans import fixpoint
from ..plans.scratch import materialize
from . import traverse

#: Labels by which ``clustering`` leaves out edges: bits of a long number.
LABELS = 62


def statistics(g: ProvGraph) -> DataFrame:
    """Ten counters in one row. Both tables are read once."""
    ti = is_traversal()
    n = g.nodes.agg(
        F.count("*").alias("total_nodes"), F.count_if(ti).alias("traversal_information_nodes"), F.count_if(~ti).alias("domain_specific_nodes"),
        *[F.count_if(F.col("kind") == k).alias(c) for k, c in (("entity", "entities"), ("activity", "activities"), ("agent", "agents"))],
        *[F.count_if(ti & has_type(t)).alias(c) for t, c in (("ForwardConnector", "forward_connectors"), ("BackwardConnector", "backward_connectors"), ("MainActivity", "main_activities"))],
    )
    return n.join(g.view("doc").agg(F.count("*").alias("total_edges")))


def type_counts(g: ProvGraph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n_nodes"), F.count_if(is_traversal()).alias("n_traversal"))


def edge_histogram(g: ProvGraph) -> DataFrame:
    """(kind, n_edges, percent)."""
    by = g.edges.groupBy(prov_kind().alias("kind")).agg(F.count("*").alias("n_edges"))
    return by.withColumn("percent", F.lit(100.0) * F.col("n_edges") / F.sum("n_edges").over(Window.partitionBy(F.lit(0))))


def degree_centrality(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, in_degree, out_degree, total_degree, centrality): distinct neighbours over n - 1."""
    a = g.adjacency(view)
    both = a.select(F.col("src").alias("n"), F.col("dst").alias("o"), F.lit(1).alias("x")).union(a.select("dst", "src", F.lit(2)))
    # one row per (node, neighbour) says in which directions they are linked: 1 out, 2 in, 3 both
    by = both.groupBy("n", "o").agg(F.sum("x").alias("x")).groupBy("n").agg(F.count_if(F.expr("x <> 1")).alias("i"), F.count_if(F.expr("x <> 2")).alias("u"), F.count("*").alias("t"))
    size = g.nodes.agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = g.nodes.select("node_id").join(by, F.col("node_id") == F.col("n"), "left").join(F.broadcast(size))
    share = F.when(F.col("size") > 1, (zero("i") + zero("u")) / (F.col("size") - 1)).otherwise(F.lit(0.0))
    return rows.select("node_id", zero("i").alias("in_degree"), zero("u").alias("out_degree"), (zero("i") + zero("u")).alias("total_degree"), zero("t").alias("n_neighbours"), share.alias("centrality"))


def hubs(g: ProvGraph, view: str = "doc") -> DataFrame:
    """The tenth of the nodes (at least one) with the highest degree; ties by arrival, then by id.

    A histogram of the degrees gives the degree at which the tenth ends, and a histogram of the
    arrivals among the nodes of that degree the arrival; only nodes equal in both are sorted.
    """
    d = degree_centrality(g, view).select(F.col("node_id").alias("_n"), F.col("total_degree").alias("degree"))
    rows = materialize(g.nodes.select("node_id", "ordinal").join(d, F.col("node_id") == F.col("_n")).select("node_id", "ordinal", "degree"), "hub-degrees")
    k = max(1, rows.count() // 10)
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"))
    degrees = rows.groupBy("degree").agg(F.count("*").alias("n"))  # as many rows as there are degrees
    edge = degrees.withColumn("upto", F.sum("n").over(above)).filter(F.col("upto") >= k).orderBy(F.desc("degree")).first()
    if edge is None:
        return rows.select("node_id", "degree")
    sure, tied, left = rows.filter(F.col("degree") > edge["degree"]), rows.filter(F.col("degree") == edge["degree"]), k - (edge["upto"] - edge["n"])
    # histograms of 1024 ranges of the arrivals, each of the range in which the one before runs full
    low, high = tied.agg(F.min("ordinal"), F.max("ordinal")).first()
    while low < high:
        width = (high - low) // 1024 + 1
        at = F.floor((F.col("ordinal") - low) / width)
        for r in tied.filter(F.col("ordinal").between(low, high)).groupBy(at.alias("at")).count().orderBy("at").collect():
            if r["count"] >= left:
                break
            left -= r["count"]
        low, high = low + r["at"] * width, min(high, low + (r["at"] + 1) * width - 1)
    rest = tied.filter(F.col("ordinal") == low).orderBy("node_id").limit(left)
    return sure.unionByName(tied.filter(F.col("ordinal") < low)).unionByName(rest).select("node_id", "degree")


def hubs_above_mean(g: ProvGraph, factor: float = 1.5, k: int = 3, view: str = "wrap") -> DataFrame:
    """The top ``k`` nodes with a degree above ``factor`` times the mean."""
    d = degree_centrality(g, view).select("node_id", F.col("total_degree").alias("degree"))
    mean = d.agg((F.avg("degree") * factor).alias("least"))
    return d.join(F.broadcast(mean)).filter("degree > least").orderBy(F.desc("degree"), "node_id").limit(k).select("node_id", "degree")


def degree_distribution(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """(degree, n_nodes). A node's degree is the number of distinct edges that it is an end of, so ends and nodes meet in one grouping."""
    # loops go after the scan: a condition on ids that reaches the source's groupings keeps nodes and edges from sharing them
    two = F.explode(F.when(F.col("src") != F.col("dst"), F.array("src", "dst")))
    ends = g.view(view).select("src", "dst").distinct().select(two.alias("n"), F.lit(0).alias("rows"), F.lit(1).alias("ends"))
    each = ends.union(g.nodes.select("node_id", F.lit(1), F.lit(0))).groupBy("n").agg(F.sum("rows").alias("rows"), F.sum("ends").alias("degree"))
    return each.filter("rows > 0").groupBy("degree").agg(F.sum("rows").alias("n_nodes"))


def complexity(g: ProvGraph, view: str = "doc") -> DataFrame:
    """One row: nodes, edges, density on raw edges, mean degree, components, score."""
    numbers, seed = fixpoint.numbered(g.nodes.select(F.col("node_id").alias("node")))
    ends = [fixpoint.number_of(end, seed).alias(c) for end, c in (("src", "a"), ("dst", "b"))]
    raw = materialize(g.view(view).select(*ends).groupBy("a", "b").agg(F.count("*").alias("n")), "complexity-edges")
    links = raw.filter("a <> b").select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("number")).groupBy("number").agg(F.count("*").alias("d"))
    member = fixpoint.contract(links)
    if member is None:
        root = numbers.select("number", F.lit(None).cast("long").alias("root")).limit(0)
    else:
        root = member.select(F.col("node").alias("number"), "root")
    rows = numbers.join(degree, "number", "left").join(root, "number", "left")
    by = rows.groupBy("root").agg(F.sum("n_rows").alias("rows"), F.sum(F.col("n_rows") * F.coalesce("d", F.lit(0))).alias("d"), F.count("*").alias("ids"))
    total = F.coalesce(F.sum("rows"), F.lit(0))
    n = by.agg(total.alias("node_count"), F.coalesce(F.sum("d") / F.sum("rows"), F.lit(0.0)).alias("average_degree"), F.coalesce(F.sum(F.when(F.col("root").isNull(), F.col("ids")).otherwise(1)), F.lit(0)).alias("component_count"))
    e = raw.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"))
    density = F.when(F.col("node_count") > 1, F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1))).otherwise(F.lit(0.0))
    row = n.join(e).select("node_count", "edge_count", "average_degree", "component_count")
    return row.withColumn("density", density).withColumn("complexity_score", F.col("density") * F.col("average_degree"))


def chain_statistics(g: ProvGraph) -> DataFrame:
    """One row over derivation chains of more than one node: count, mean, longest."""
    chains = traverse.derivation_chains(g).filter("length > 1")
    return chains.agg(F.count("*").alias("total_chains"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length"), F.coalesce(F.max("length"), F.lit(0)).alias("longest_chain"))


def graph_statistics(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """One row on distinct edges: connectivity, whether acyclic, density, degrees; raw edges counted too."""
    a = materialize(g.view(view).select("src", "dst").distinct(), "distinct-edges")
    peeled = fixpoint.levels(g.nodes.select(F.col("node_id").alias("node")), a)
    loops = a.filter("src = dst").agg((F.count("*") > 0).alias("loops"))
    n = g.nodes.agg(F.count("*").alias("num_nodes"))
    ends = a.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    d = g.nodes.select("node_id").join(ends, F.col("node_id") == F.col("n"), "left").agg(*[f(F.coalesce("d", F.lit(0))).alias(f"{k}_degree") for k, f in (("average", F.avg), ("max", F.max), ("min", F.min))])
    c = traverse.connected_components(g, view).agg(F.count_distinct("component").alias("num_components"))
    row = n.join(g.view(view).agg(F.count("*").alias("num_edges"))).join(a.agg(F.count("*").alias("num_distinct_edges"))).join(c).join(d).join(peeled.agg(F.count("*").alias("peeled"))).join(loops)
    density = F.when(F.col("num_nodes") > 1, F.col("num_distinct_edges") / (F.col("num_nodes") * (F.col("num_nodes") - 1))).otherwise(F.lit(0.0))
    return row.select("num_nodes", "num_edges", "num_distinct_edges", (F.col("num_components") == 1).alias("is_connected"), "num_components", ((F.col("peeled") == F.col("num_nodes")) & ~F.col("loops")).alias("is_dag"), density.alias("density"), "average_degree", "max_degree", "min_degree")


def adjacency_metrics(g: ProvGraph, view: str = "doc") -> DataFrame:
    """One row on distinct adjacency: edges, density."""
    n = g.nodes.agg(F.count("*").alias("n"))
    return g.adjacency(view).agg(F.count("*").alias("edge_count")).join(n).select("edge_count", F.when(F.col("n") > 1, F.col("edge_count") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("density"))


def linked_components(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(component, n_nodes): components of nodes with an edge; isolated nodes are left out."""
    a = g.adjacency(view)
    ends = a.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return fixpoint.components(ends, a).groupBy("component").agg(F.count("*").alias("n_nodes"))


def diameter(g: ProvGraph, view: str = "doc") -> DataFrame:
    """One row: the greatest finite distance (0 without edges)."""
    return traverse.distances(g, view=view).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("diameter"))


def closeness(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, closeness): one over the mean distance to the nodes reached, for nodes with an out-edge."""
    return traverse.successor_counts(g, view=view, itself=False).select(F.col("start").alias("node_id"), (F.col("n_reached") / F.col("total")).alias("closeness"))


def betweenness(g: ProvGraph, view: str = "doc", all_targets: bool = False) -> DataFrame:
    """(node_id, betweenness): share of shortest paths through a node, scaled by 2 / ((n-1)(n-2)).

    Sources and targets are nodes with an out-edge (all reached nodes with ``all_targets``), and n
    counts them. Paths are counted, not listed: of the shortest ways from s to t, those through v
    are the ways to v times the ways on, where the distances add up. It looks at all pairs of
    nodes with what lies between, so it is meant for typed subgraphs.
    """
    a = materialize(g.adjacency(view), "between-edges")
    sources = materialize(a.select(F.col("src").alias("node")).distinct(), "between-nodes")
    ways = materialize(fixpoint.shortest_counts(a), "between-ways")
    ends = ways if all_targets else ways.join(sources, "node", "left_semi")
    to_v = ways.select("start", F.col("node").alias("v"), F.col("depth").alias("d1"), F.col("ways").alias("w1"))
    on = ends.select(F.col("start").alias("v"), F.col("node").alias("target"), F.col("depth").alias("d2"), F.col("ways").alias("w2"))
    whole = ends.select("start", F.col("node").alias("target"), F.col("depth").alias("d"), F.col("ways").alias("w"))
    through = to_v.join(on, "v").filter("start <> target").join(whole, ["start", "target"]).filter("d1 + d2 = d")
    n = sources.agg(F.count("*").alias("n"))
    total = through.groupBy(F.col("v").alias("node_id")).agg(F.sum(F.col("w1") * F.col("w2") / F.col("w")).alias("total")).join(F.broadcast(n))
    return total.select("node_id", F.when(F.col("n") > 2, F.col("total") * 2 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(F.col("total")).alias("betweenness"))


def clustering(g: ProvGraph, view: str = "doc") -> DataFrame:
    """One row: mean over nodes with out-edges of linked pairs among a node's out-neighbours.

    An unordered pair counts once if it is linked in either direction. Linked pairs are found from
    the links: for each link, the nodes that point at that of its ends at which fewer do, and of
    them those that point at the other too. Only edges that can be in such a triangle are shuffled.
    """
    e = g.view(view).filter("src <> dst").select("src", "dst")
    able, n = _triangle_edges(e)
    a = materialize(able.distinct(), "cluster-edges")
    into = a.groupBy("dst").agg(F.count("*").alias("d"))
    end = lambda c: into.select(F.col("dst").alias(c), F.col("d").alias(f"d_{c}"))
    links = a.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct().join(end("x"), "x").join(end("y"), "y")
    fewer = F.struct(F.col("d_x").alias("d"), F.col("x").alias("near"), F.col("y").alias("far")), F.struct(F.col("d_y").alias("d"), F.col("y").alias("near"), F.col("x").alias("far"))
    links = links.select(F.least(*fewer).alias("l")).select("l.near", "l.far")
    over = links.join(a.select(F.col("src").alias("s"), F.col("dst").alias("near")), "near").join(a.select(F.col("src").alias("s"), F.col("dst").alias("far")), ["s", "far"])
    found = materialize(over.groupBy("s").agg(F.count("*").alias("linked")), "cluster-found")
    near = e.join(found.select(F.col("s").alias("src")), "src", "left_semi").distinct().groupBy("src").agg(F.count("*").alias("k"))
    total = near.join(found, F.col("src") == F.col("s")).agg(F.coalesce(F.sum(F.col("linked") / (F.col("k") * (F.col("k") - 1) / 2)), F.lit(0.0)).alias("total"))
    return total.select((F.col("total") / max(1, n)).alias("clustering"))


def _triangle_edges(e: DataFrame) -> tuple[DataFrame, int]:
    """The edges of ``e`` (src, dst) without those that cannot be in a triangle of s to x, s to y and a link of x and y; the number of sources.

    A node is labelled by a hash of what precedes the first colon of its id. Edges of such a triangle join labels
    that form one themselves, so edges between other labels go; one pass over the edges tells which labels they join.
    """
    a, b = (F.pmod(F.xxhash64(F.substring_index(c, ":", 1)), F.lit(LABELS)).cast("int") for c in ("src", "dst"))
    by = e.select("src", b.alias("b")).groupBy("src").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("to"))
    rows = by.groupBy(a.alias("a")).agg(F.bit_or("to").alias("to"), F.count("*").alias("n")).collect()
    out = {r.a: {y for y in range(LABELS) if r.to >> y & 1} for r in rows}
    able = {p for x in out for y in out[x] for s in out if x in out[s] and y in out[s] for p in ((x, y), (s, x), (s, y))}
    kept = e.filter((a * LABELS + b).isin([x * LABELS + y for x, y in able])) if able else e.limit(0)
    return kept, sum(r.n for r in rows)


def in_degrees(g: ProvGraph, view: str = "doc") -> DataFrame:
    d = g.adjacency(view).groupBy("dst").agg(F.count("*").alias("d"))
    return g.nodes.select("node_id").join(d, F.col("node_id") == F.col("dst"), "left").select("node_id", F.coalesce("d", F.lit(0)).alias("in_degree"))


def priority_centrality(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, centrality): weight of the type, times known, and neighbours."""
    d = degree_centrality(g, view).select(F.col("node_id").alias("_n"), "in_degree", "out_degree")
    base = F.when(has_type("MainActivity"), 10.0).when(has_type("SubActivity"), 5.0).when(has_type("StorageActivity"), 3.0).otherwise(0.0)
    value = base + F.when(F.col("start_time").isNotNull(), 2.0).otherwise(0.0) + F.when(F.col("end_time").isNotNull(), 2.0).otherwise(0.0) + 0.5 * F.col("out_degree") + 0.3 * F.col("in_degree")
    return g.nodes.join(d, F.col("node_id") == F.col("_n")).select("node_id", value.alias("centrality"))


def influence_scores(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(node_id, score): 2 per one-hop successor and 0.5 per successor within three hops."""
    near = traverse.successors(g, max_depth=3, view=view)
    by = near.groupBy("start").agg((2.0 * F.count_if(F.expr("depth = 1")) + 0.5 * F.count("*")).alias("score"))
    return g.nodes.select("node_id").join(by, F.col("node_id") == F.col("start"), "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def anomalies(g: ProvGraph, view: str = "doc") -> DataFrame:
    """(anomaly, node_id): isolated, high_degree (above a tenth of the nodes), missing_timestamps, broken_chain."""
    d = degree_centrality(g, view).select(F.col("node_id").alias("_n"), "total_degree", "out_degree", "n_neighbours")
    size = g.nodes.agg(F.count("*").alias("size"))
    rows = g.nodes.join(d, F.col("node_id") == F.col("_n")).join(F.broadcast(size))
    kinds = F.array_compact(F.array(
        F.when(F.col("total_degree") == 0, F.lit("isolated")),
        F.when(F.col("total_degree") > 0.1 * F.col("size"), F.lit("high_degree")),
        F.when((F.col("kind") == "activity") & (F.col("start_time").isNull() | F.col("end_time").isNull()), F.lit("missing_timestamps")),
        F.when(has_type("MainActivity") & (F.col("out_degree") == 0), F.lit("broken_chain")),
    ))
    return rows.select(F.explode(kinds).alias("anomaly"), "node_id")
