"""Sources are read once, with the columns that are asked for."""

import json

from pyspark.sql import functions as F

from provgraph import graph
from provgraph.operators import merge
from provgraph.plans import scratch
from provgraph.sources import formats
from provgraph.sources.relational import order_graph


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_edges_of_the_order_graph_do_not_shuffle_prices(spark, sf, tmp_path):
    """Lines under one number: the part and supplier of the least line are the least pair, nulls first."""
    assert "l_extendedprice" not in _plan(order_graph(spark, sf).edges)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        if t == "lineitem":
            one = rows.filter("l_orderkey = (SELECT 1L)").limit(1)
            rows = one.withColumns({"l_partkey": F.lit(3).cast("long"), "l_suppkey": F.lit(9).cast("long"), "l_quantity": F.lit(1.0)})
            rows = rows.union(one.withColumns({"l_partkey": F.lit(3).cast("long"), "l_suppkey": F.lit(None).cast("long"), "l_quantity": F.lit(7.0)})).union(one.withColumns({"l_partkey": F.lit(4).cast("long"), "l_suppkey": F.lit(1).cast("long"), "l_quantity": F.lit(0.5)}))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    g = order_graph(spark, str(tmp_path))
    ends = {(r.relation, r.arg2) for r in g.edges.filter("arg1 LIKE 'item:%'").collect()}
    assert ends == {("generation", "order:1"), ("derivation", "part:3"), ("attribution", "supp:")}
    assert [r.value for r in g.attrs.filter("name = 'attr:quantity'").collect()] == ["7.0"]


def test_difference_groups_once_and_counts_records(spark):
    base = graph.empty(spark)
    of = lambda *ids: base.with_(nodes=spark.createDataFrame([("b", i, "entity", [], None, None, False, 0) for i in ids], base.nodes.schema))
    found = merge.difference(of("a", "a", "a", "b", "c"), of("a", "b", "d", "d"))
    assert _plan(found).count("Exchange hashpartitioning") == 1
    assert sorted((r.side, r.record_class, r.id) for r in found.collect()) == [("first", "node", "a entity")] * 2 + [("first", "node", "c entity")] + [("second", "node", "d entity")] * 2


def test_prov_json_is_parsed_once(spark, monkeypatch):
    """Types of records under one id are united, by prefixes looked up in the row or joined."""
    q = lambda t: {"$": t, "type": "prov:QUALIFIED_NAME"}
    doc = {"prefix": {"ex": "http://e/"}, "bundle": {"ex:b": {"prefix": {"in": "http://i/"}, "entity": {"ex:a": [{"prov:type": [q("ex:T"), q("odd:U")]}, {"prov:type": q("in:V")}, {"prov:type": q("ex:T")}], "ex:n": {}}, "used": {"_:1": {"prov:activity": "ex:gone", "prov:entity": "ex:a"}}}}}
    found = []
    for few in (1000, 0):
        monkeypatch.setattr(formats, "FEW_NAMESPACES", few)
        before = len(scratch._SCRATCH)
        g = formats.import_document(spark, json.dumps(doc))
        assert [p.rpartition("/")[2].rpartition("-")[0] for _, p in scratch._SCRATCH[before:]] == ["json-records"]
        found.append(sorted((r.node_id, r.kind, [t.uri for t in r.types]) for r in g.nodes.collect()))
    assert found[0] == found[1] == [("ex:a", "entity", ["http://e/T", "http://i/V", "http://example.org/odd/U"]), ("ex:gone", "unknown", []), ("ex:n", "entity", [])]
