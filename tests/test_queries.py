"""Registered queries against their SQL on the whole small tables, and the parts that SQL does not reach."""

import heapq

import duckdb
import pytest
from pyspark.sql import functions as F

from provgraph import queries, queries_edit, queries_io, queries_select
from provgraph.errors import InvalidOperationError, NodeNotFoundError
from provgraph.graph import empty
from provgraph.operators import edit, merge, metrics, schedule, select, validate
from provgraph.sources import formats
from provgraph.sources.relational import activity_graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
MINE = [n for n in queries.SQL if any(n in vars(m) for m in (queries_edit, queries_io, queries_select))]


def plain(v):
    return None if v is None else str(v) if isinstance(v, (bool, str)) else f"{float(v):.9g}"


@pytest.mark.parametrize("name", [*MINE, "cross_part_edges", "betweenness", "hub_nodes", "document_complexity", "adapter_statistics"])
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    rows = lambda x: sorted(tuple(map(plain, r)) for r in x)
    assert rows(map(repr_none, got.collect())) == rows(tuple(repr_none(r)[k] for k in order) for r in want.fetchall())


def repr_none(row):
    return tuple("null" if v is None else v for v in row)


def test_execution_order_by_brute_force(spark, sf):
    """Kahn's order with a plain queue over the whole graph, component by component."""
    g = activity_graph(spark, sf).materialized()
    scores = schedule.priorities(g).collect()
    got = {}
    for r in schedule.execution_order(g).collect():
        got.setdefault(r.component, {})[r.position] = r.node_id
    after, needs = {}, {r.node_id: set() for r in scores}
    for r in g.adjacency("doc").collect():
        after.setdefault(r.src, []).append(r.dst)
        needs[r.dst].add(r.src)
    rank, arrival = {r.node_id: r.priority for r in scores}, {r.node_id: r.ordinal for r in scores}
    assert sum(map(len, got.values())) == len(rank)
    for order in got.values():
        nodes = [order[k] for k in range(len(order))]
        place = {x: k for k, x in enumerate(nodes)}
        assert all(place[s] < place[x] for x in nodes for s in needs[x])
        first = sorted((x for x in nodes if not needs[x]), key=lambda x: (rank[x], x), reverse=True)
        queue = [(-rank[x], k, x) for k, x in enumerate(first)]
        heapq.heapify(queue)
        left, tick, want, ties = {x: len(needs[x]) for x in nodes}, len(queue), [], False
        while queue:
            x = heapq.heappop(queue)[2]
            want.append(x)
            ready = []
            for y in after.get(x, []):
                left[y] -= 1
                if not left[y]:
                    ready.append(y)
            for y in sorted(ready, key=lambda y: arrival[y]):
                heapq.heappush(queue, (-rank[y], tick, y))
                tick += 1
            ties |= len({arrival[y] for y in ready}) < len(ready)
        assert ties or nodes == want  # among equals in rank and arrival any order will do


def test_hubs_break_ties_by_arrival(spark):
    rows = [("b", f"n{i}", "entity", [], None, None, False, (i * 7) % 300) for i in range(300)]
    g = empty(spark)
    g = g.with_(nodes=spark.createDataFrame(rows, g.nodes.schema), edges=spark.createDataFrame([("b", "e", "derivation", "n5", "n6", 0)], g.edges.schema))
    got = {r.node_id for r in metrics.hubs(g).collect()}
    rest = sorted((r[7], r[1]) for r in rows if r[1] not in ("n5", "n6"))
    assert got == {"n5", "n6"} | {i for _, i in rest[:28]}


def test_many_main_activities_are_counted_not_listed(spark):
    g = empty(spark)
    rows = spark.range(500).select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("node_id"), F.lit("activity").alias("kind"), F.array(F.struct(F.lit("cpm").alias("prefix"), F.lit("MainActivity").alias("local"), F.lit("https://commonprovenancemodel.org/ns/cpm/MainActivity").alias("uri"))).alias("types"))
    g = edit.add_nodes(g, rows)
    found = validate.structure(g).filter("code = 'multiple_main_activities'").collect()
    assert len(found) == 1 and found[0].message.endswith("m018, m019 and 480 more") and select.main_activities(g).count() == 500


def test_bulk_edits_and_builders_refuse(spark):
    g = edit.add_nodes(empty(spark), spark.createDataFrame([("a", "entity"), ("b", "Activity")], "node_id string, kind string"))
    for rows in ([("a", "entity")], [("c", "thing")], [("c", "agent"), ("c", "agent")], [(None, "agent")]):
        with pytest.raises(InvalidOperationError):
            edit.add_nodes(g, spark.createDataFrame(rows, "node_id string, kind string"))
    with pytest.raises(NodeNotFoundError):
        edit.add_edges(g, spark.createDataFrame([("used", "b", "zz")], "relation string, arg1 string, arg2 string"))
    with pytest.raises(InvalidOperationError):
        edit.add_edges(g, spark.createDataFrame([("nonsense", "b", "a")], "relation string, arg1 string, arg2 string"))
    for builder in (edit.EdgeBuilder(), edit.EdgeBuilder().with_relation("used"), edit.EdgeBuilder().with_relation("used").with_cause("a")):
        with pytest.raises(ValueError, match="an edge needs a"):
            builder.build(g)


def test_groupings_can_be_registered(spark):
    g = edit.add_nodes(empty(spark), spark.createDataFrame([("a", "entity"), ("b", "activity")], "node_id string, kind string"))
    g = edit.add_edges(g, spark.createDataFrame([("used", "b", "a"), ("wasInfluencedBy", "b", "a")], "relation string, arg1 string, arg2 string"))
    assert [merge.grouped_edges(g, m).count() for m in (None, "merged", "divided")] == [1, 1, 2]
    merge.register_grouping("none", lambda g, view: g.view(view).limit(0), default=True)
    try:
        assert merge.grouped_edges(g).count() == 0
    finally:
        del merge.GROUPINGS["none"]
    with pytest.raises(ValueError):
        merge.grouped_edges(g, "none")


def test_ntriples_literals(spark):
    """Each escape once, from left to right; datatypes stay."""
    body = r'a\nb \\n \"q\" \t é \U0001F600 \\u00e9'
    lines = [f'<http://x/e> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/ns/prov#Entity> .', f'<http://x/e> <http://x/note> "{body}" .', '<http://x/e> <http://x/size> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .']  # noqa: F541
    g = formats.ntriples_graph(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.name: (r.value, r.value_type) for r in g.attrs.collect()}
    assert got == {"http://x/note": ('a\nb \\n "q" \t é \U0001f600 \\u00e9', "xsd:string"), "http://x/size": ("5", "xsd:integer")}
