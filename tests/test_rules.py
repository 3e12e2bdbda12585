"""Rules share one look at the nodes, and their findings are written one by one."""

from provgraph import graph
from provgraph.operators import validate
from provgraph.plans import scratch


def test_findings_are_planned_one_rule_at_a_time(spark):
    base = graph.empty(spark)
    kinds = [("a", "entity"), ("b", "activity"), ("b", "entity"), ("c", "agent"), ("alone", "entity"), ("alone", "entity"), ("odd", "plan"), ("odd", "agent"), (None, "entity")]
    nodes = [("x", i, k, [], None, None, False, n) for n, (i, k) in enumerate(kinds)]
    edges = [("x", f"e{n}", r, a, b, n) for n, (r, a, b) in enumerate([("usage", "b", "a"), ("usage", "b", "c"), ("generation", "a", "b"), ("association", "b", "c"), ("derivation", "odd", "odd"), ("usage", "gone", "a")])]
    g = base.with_(nodes=spark.createDataFrame(nodes, base.nodes.schema), edges=spark.createDataFrame(edges, base.edges.schema), bundles=spark.createDataFrame([("x",)], base.bundles.schema))
    before = len(scratch._SCRATCH)
    found = validate.validate(g).findings
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert not any("/attrs-" in path for _, path in scratch._SCRATCH[before:])
    got = sorted((r.code, r.node_id or r.edge_id or "", r.message.rpartition("got ")[2] if "invalid" in r.code else "") for r in found.collect())
    assert got == sorted([
        ("node_missing_identifier", "", ""), ("isolated_node", "", ""), ("isolated_node", "alone", ""), ("isolated_node", "alone", ""), ("self_loop_edge", "e4", ""), ("graph_not_connected", "", ""),
        ("inconsistent_node_types", "b", ""), ("inconsistent_node_types", "odd", ""), ("invalid_association_relation", "e3", "Agent -> Entity"), ("invalid_generation_relation", "e2", "Entity -> Entity"),
        ("invalid_usage_relation", "e0", "Entity -> Entity"), ("invalid_usage_relation", "e1", "Agent -> Activity"), ("invalid_usage_relation", "e1", "Agent -> Entity"),
    ])
    assert [r.message for r in found.filter("code = 'graph_not_connected'").collect()] == ["Graph not fully connected: 4/8 nodes reachable"]
