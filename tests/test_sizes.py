"""What a query writes and how far its work grows, on small tables with odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from provgraph import graph, queries, queries_edit, queries_io, queries_select  # noqa: F401
from provgraph.operators import metrics, traverse
from provgraph.plans import fixpoint, scratch, tiles
from provgraph.sources.relational import activity_graph, order_graph

#: Queries that read the order graph once or twice; none of them needs a copy of it.
ONCE = ("node_type_names", "collection_members", "single_edge", "graph_difference", "node_degrees", "subgraph_groupings", "influence_network", "degree_distribution", "anomalies", "unmapped_relations")


@pytest.mark.parametrize("name", ONCE)
def test_query_writes_no_copy_of_the_graph(spark, sf, name):
    before = len(scratch._SCRATCH)
    got = queries.QUERIES[name](spark, sf).count()
    assert len(scratch._SCRATCH) == before
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert got == len(con.execute(queries.SQL[name]).fetchall())


def test_missing_ends_are_those_that_all_edges_and_nodes_show(spark, sf, tmp_path):
    """Keys without a row of their own, null ones among them, and a line whose odd part another line of its number hides."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        key = rows.columns[0]
        if t in ("part", "supplier", "customer", "orders", "nation"):
            rows = rows.filter(F.col(key) % 7 != 3)
        if t == "lineitem":
            odd = rows.limit(5).withColumns({"l_partkey": F.lit(10**9), "l_suppkey": F.lit(None).cast("long")})
            rows = rows.union(odd.withColumn("l_partkey", F.lit(10**9 + 1))).union(odd.withColumn("l_linenumber", F.lit(99)))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    g = order_graph(spark, str(tmp_path))
    declared = g.with_(nodes=g.nodes.filter("NOT is_placeholder"))
    rows = lambda n: sorted((r.node_id, r.kind, r.ordinal) for r in n.collect())
    want = rows(graph.placeholders(declared))
    assert rows(g.nodes.filter("is_placeholder")) == want and len(want) > 100 and ("part:1000000001", "unknown", 0) not in want
    a = activity_graph(spark, sf)
    assert graph.placeholders(a).isEmpty()


def _graph(spark, edges, alone=(), twice=()):
    """A graph of entities from derivations (src, dst); ids in ``twice`` have two records."""
    ids = sorted({x for e in edges for x in e} | set(alone))
    base = graph.empty(spark)
    nodes = [("b", i, "entity", [], None, None, False, 0) for i in [*ids, *twice]]
    rows = [("b", f"{a}|{b}|{k}", "derivation", a, b, 0) for k, (a, b) in enumerate(edges)]
    return base.with_(nodes=spark.createDataFrame(nodes, base.nodes.schema), edges=spark.createDataFrame(rows, base.edges.schema))


def _walks(edges, source, target, most):
    if source == target:
        return [[source]]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, walk = [], [[source]]
    for _ in range(most):
        walk = [[*w, x] for w in walk for x in near.get(w[-1], ()) if x not in w]
        out += [w for w in walk if w[-1] == target]
        walk = [w for w in walk if w[-1] != target]
    return out


def test_undirected_paths_join_half_ways(spark):
    """All depths against plain walks, with loops, parallel edges and a pair given twice; hops of a hub are not listed per pair."""
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c"), ("e", "d"), ("e", "e"), ("a", "b"), ("f", "g")]
    pairs = [(x, y) for x in "abcdefg" for y in "abcdeg"] + [("a", "c")]
    g = _graph(spark, edges)
    for most in (0, 1, 2, 3, 4):
        got = sorted((r.source, r.target, *r.path) for r in traverse.undirected_paths(g, spark.createDataFrame(pairs, "source string, target string"), most).collect())
        assert got == sorted((s, t, *w) for s, t in pairs for w in _walks(edges, s, t, most))
    hub = [(f"{k}{i}", "hub") for k in "st" for i in range(2500)]
    some = spark.createDataFrame([(f"s{i}", f"t{j}") for i in range(250) for j in range(400)], "source string, target string")
    assert traverse.undirected_paths(_graph(spark, hub), some).count() == 100_000


@pytest.mark.parametrize("side", [1, 2, 1024])
def test_undirected_paths_in_groups_are_those_of_their_pairs(spark, monkeypatch, side):
    """All depths against plain walks, in tiles of any size; rows given twice, ends in several groups and in none, a source that is its own target."""
    monkeypatch.setattr(tiles, "SIDE", side)
    monkeypatch.setattr(tiles, "TASK", 5)
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c"), ("e", "d"), ("e", "e"), ("a", "b"), ("f", "g")]
    sources = [(x, k) for k in ("k", "l") for x in "abcdefg" if (x, k) != ("b", "l")] + [("a", "k"), ("b", None), ("c", "m")]
    targets = [(x, "k") for x in "abcdeg"] + [("a", "l"), ("c", "l"), ("c", "l"), ("d", None), ("d", "n")]
    pairs = [(s, t) for s, k in sources for t, m in targets if k is not None and k == m]
    g, frame = _graph(spark, edges), spark.createDataFrame
    for most in (0, 1, 2, 3, 4) if side == 2 else (3,):
        want = sorted((s, t, *w) for s, t in pairs for w in _walks(edges, s, t, most))
        for sep in (None, "|"):
            got = traverse.undirected_paths_in_groups(g, frame(sources, "source string, group string"), frame(targets, "target string, group string"), most, sep=sep).collect()
            assert sorted((r.source, r.target, *(r.path.split("|") if sep else r.path)) for r in got) == want


def test_undirected_paths_of_a_nation_are_not_shuffled(spark, sf, tmp_path):
    """1,000 customers and 500 suppliers of one nation: half a million rows, of which none is dealt out after it is made."""
    for t in ("region", "nation", "part", "orders", "lineitem"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for t, n, key, nation in (("customer", 1000, "c_custkey", "c_nationkey"), ("supplier", 500, "s_suppkey", "s_nationkey")):
        one = spark.read.parquet(f"{sf}/{t}.parquet").limit(1).drop(key, nation)
        spark.range(n).withColumnRenamed("id", key).withColumn(nation, F.lit(3)).crossJoin(one).write.parquet(f"{tmp_path}/{t}.parquet")
    sc, key = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)))

    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        bytes_before = shuffled()
        got = queries.QUERIES["undirected_paths"](spark, str(tmp_path))
        got.write.parquet(f"{tmp_path}/out")
        assert shuffled() - bytes_before < 500_000
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 500_000 and out.filter("path <> concat_ws(' ', source, 'nation:3', target)").isEmpty()


def test_complexity_counts_from_numbers(spark, monkeypatch):
    """Loops, parallel and opposite edges, doubled records and lone nodes; ids that share a number get another seed."""
    edges = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", "e"), ("e", "f")]
    real = fixpoint.number_of
    monkeypatch.setattr(fixpoint, "number_of", lambda node, seed=0: real(node, seed) % 3 if seed == 0 else real(node, seed))
    r = metrics.complexity(_graph(spark, edges, ["z"], ["a"])).first()
    assert (r.node_count, r.edge_count, r.component_count) == (8, 6, 4) and r.average_degree == pytest.approx((2 * 2 + 2 + 1 + 2 + 1) / 8)
    empty = metrics.complexity(graph.empty(spark)).first()
    assert (empty.node_count, empty.edge_count, empty.component_count, empty.average_degree) == (0, 0, 0, 0.0)
    assert metrics.complexity(_graph(spark, [], ["x", "y"])).first().component_count == 2
    star = [(7, i) for i in range(10, 400)] + [(1, 2), (2, 3)]
    for few in (0, 5, 1000):
        monkeypatch.setattr(fixpoint, "FEW", few)
        found = fixpoint.contract(spark.createDataFrame(star, "a long, b long")).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.root, set()).add(r.node)
        assert sorted(map(len, groups.values())) == [3, 391]
    chain = _graph(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("p", "q")], ["z"])
    assert dict(traverse.connected_components(chain).groupBy("component").count().collect()) == {"n000": 61, "p": 2, "z": 1}


def _clustering(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
    linked = lambda x, y: y in near.get(x, ()) or x in near.get(y, ())
    each = [sum(linked(x, y) for x in n for y in n if x < y) / (len(n) * (len(n) - 1) / 2) if len(n) > 1 else 0.0 for n in near.values()]
    return sum(each) / len(each) if each else 0.0


def test_clustering_against_plain_counts_with_and_without_labels(spark, monkeypatch):
    """Loops, parallel and opposite edges, labels that form no triangle; ids without labels, labels that share a bit."""
    rng = __import__("random").Random(7)
    mixed = [(f"{rng.choice('abc')}:{rng.randrange(6)}", f"{rng.choice('abcd')}:{rng.randrange(6)}") for _ in range(70)]
    schema = [(f"a:{i}", f"b:{i % 3}") for i in range(9)] + [(f"b:{i}", "c:0") for i in range(3)] + [("c:0", "a:1"), ("c:0", "c:0")]
    plain = [(x.replace(":", ""), y.replace(":", "")) for x, y in mixed]
    for edges in (mixed, mixed + mixed[:9], schema, schema + [("a:1", "c:0")], plain, [("a:1", "a:1")]):
        for labels in (1, 2, 62):
            monkeypatch.setattr(metrics, "LABELS", labels)
            assert metrics.clustering(_graph(spark, edges)).first().clustering == pytest.approx(_clustering(edges))


def test_clustering_starts_at_the_end_of_a_link_with_fewer_sources(spark):
    """A hub that 3,000 nodes point at is linked to 3,000 others at which none does: nine million pairs if one goes out from the hub."""
    edges = [(f"n:{i}", "a:hub") for i in range(3000)] + [(f"z:{i}", "a:hub") for i in range(3000)] + [("n:1", "z:1")]
    assert metrics.clustering(_graph(spark, edges)).first().clustering == pytest.approx(1 / 6000)
    before = len(scratch._SCRATCH)
    metrics.clustering(_graph(spark, edges[:6000]))
    made = [p for _, p in scratch._SCRATCH[before:] if "cluster-edges" in p]
    assert made and all(spark.read.parquet(p).isEmpty() for p in made)
