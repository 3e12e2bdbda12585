"""Graph operators on small fixtures, by value."""

import random

import pytest
from pyspark.sql import functions as F

from provgraph.document import ProvenanceDocument
from provgraph.errors import InvalidOperationError, MultipleEdgesError, NodeNotFoundError
from provgraph.graph import graph_of
from provgraph.operators import edit, merge, metrics, schedule, select, traverse, validate
from provgraph.schema import RELATIONS, relation_name

ENTITIES = ["e1", "e2", "e3"]


@pytest.fixture(scope="module")
def base(spark):
    """A main activity with two connectors, two agents and a derivation chain of three entities."""
    d = ProvenanceDocument.empty(spark)
    d = d.add_node("activity", "test:main", prov_type="cpm:MainActivity", start_time="2024-01-01T00:00:00")
    for name, kind in (("fc1", "ForwardConnector"), ("bc1", "BackwardConnector")):
        d = d.add_node("entity", f"test:{name}", {"cpm:referencedBundleId": "test:b", "cpm:referencedBundleHashValue": "h"}, f"cpm:{kind}")
    d = d.add_node("agent", "test:sender", prov_type="cpm:SenderAgent").add_node("agent", "test:receiver", prov_type="cpm:ReceiverAgent")
    for e in ENTITIES:
        d = d.add_node("entity", f"test:{e}", {"label": [e, "shared"]})
    return ProvenanceDocument(d.graph.materialized())


@pytest.fixture(scope="module")
def doc(base):
    d = base.add_edge("used", "test:main", "test:e1").add_edge("wasGeneratedBy", "test:main", "test:e2")
    d = d.add_edge("wasDerivedFrom", "test:e2", "test:e1").add_edge("wasDerivedFrom", "test:e3", "test:e2")
    return ProvenanceDocument(d.graph.materialized())


def ids(rows, column="node_id"):
    return sorted(r[column].removeprefix("test:") for r in rows.collect())


def pairs(rows, a="src", b="dst"):
    return sorted((r[a].removeprefix("test:"), r[b].removeprefix("test:")) for r in rows.collect())


def test_directions_of_all_relations(spark):
    edges = spark.createDataFrame([(None, f"r{k}", r, "x", "y", k) for k, r in enumerate(RELATIONS)], "bundle_id string, edge_id string, relation string, arg1 string, arg2 string, ordinal long")
    g = graph_of(spark.createDataFrame([], "bundle_id string, node_id string, kind string, types array<struct<prefix: string, local: string, uri: string>>, start_time timestamp, end_time timestamp, is_placeholder boolean, ordinal long"), edges)
    got = {r.relation: (r.cause, r.effect, r.src, r.dst) for r in g.directed.collect()}
    assert all(v[:2] == ("y", "x") for v in got.values())
    assert {k for k, v in got.items() if v[2:] == ("y", "x")} == {"usage", "generation", "attribution"}
    assert {k for k, v in got.items() if v[2] is None} == {"start", "end", "invalidation"}
    assert ids(g.nodes.filter("is_placeholder AND kind = 'unknown'")) == ["x", "y"]


def test_relation_names():
    assert relation_name("PROV_DERIVATION") == relation_name("wasderivedfrom") == relation_name("derived") == "derivation"
    assert relation_name("wasAttributedTo") == "attribution"
    with pytest.raises(ValueError):
        relation_name("nonsense")


def test_statistics(doc):
    assert doc.get_statistics() == {
        "total_nodes": 8, "traversal_information_nodes": 5, "domain_specific_nodes": 3, "entities": 5, "activities": 1, "agents": 2, "forward_connectors": 1, "backward_connectors": 1, "main_activities": 1, "total_edges": 4,
    }


def test_selection(doc):
    g = doc.graph
    assert ids(doc.get_nodes_by_type("mainactivity")) == ["main"] and ids(doc.get_nodes_by_type("cpm:SenderAgent")) == ["sender"]
    assert ids(doc.get_nodes_by_type("prov:agent")) == ["receiver", "sender"]
    assert ids(doc.get_nodes_by_attribute("attr:label", "e2")) == ["e2"] and ids(doc.get_nodes_by_attribute("attr:label")) == ENTITIES
    assert [r.value for r in doc.get_prov_attribute("test:e1", "attr:label").collect()] == ["e1", "shared"]
    assert doc.get_node("test:nope") is None and doc.get_node("test:e1").kind == "entity"
    assert pairs(g.view("doc")) == [("e1", "e2"), ("e1", "main"), ("e2", "e3"), ("main", "e2")]
    assert pairs(doc.get_edges(relation_type="wasDerivedFrom")) == [("e1", "e2"), ("e2", "e3")]
    assert pairs(doc.get_edges("test:e1")) == [("e1", "e2"), ("e1", "main")]
    assert doc.get_edge("test:e2", "test:e1").relation == "derivation"  # found by its swapped ends
    assert pairs(doc.get_cross_part_edges()) == [("e1", "main"), ("main", "e2")]
    assert ids(doc.get_connected_nodes("test:e2")) == ["e1", "e3", "main"]
    assert ids(select.isolated_nodes(g)) == ["bc1", "fc1", "receiver", "sender"]
    assert doc.are_all_relations_mapped() and doc.get_main_activity().node_id == "test:main"
    degree = {r.node_id: (r.in_degree, r.out_degree) for r in select.node_degrees(g, "doc").collect()}
    assert degree["test:e2"] == (2, 1) and degree["test:sender"] == (0, 0)
    assert ids(select.neighbours(g, "test:e2", "in", "doc")) == ["e1", "main"]


def test_ambiguous_edges_raise(doc):
    both = doc.add_edge("wasInfluencedBy", "test:e1", "test:e2")
    with pytest.raises(MultipleEdgesError):
        both.get_edge("test:e1", "test:e2")
    assert both.get_edge("test:e1", "test:e2", "influence").relation == "influence"


def test_traversal(doc):
    assert ids(doc.get_predecessors("test:e2"), "node") == ["e1", "main"] and ids(doc.get_predecessors("test:e3"), "node") == ["e1", "e2", "main"]
    assert ids(doc.get_predecessors("test:e3", max_depth=1), "node") == ["e2"]
    assert ids(doc.get_successors("test:e1", ["wasDerivedFrom"]), "node") == ["e2", "e3"]
    paths = sorted([x.removeprefix("test:") for x in r.path] for r in doc.find_paths("test:e1", "test:e3").collect())
    assert paths == [["e1", "e2", "e3"], ["e1", "main", "e2", "e3"]]
    assert doc.find_paths("test:e1", "test:e3", 3).count() == 1 and doc.find_paths("test:e3", "test:e1").count() == 0
    assert [r.path for r in doc.find_paths("test:e1", "test:e1").collect()] == [["test:e1"]]
    by = doc.get_connected_components().groupBy("component").count().collect()
    assert sorted(r["count"] for r in by) == [1, 1, 1, 1, 4]
    assert ids(doc.get_subgraph(["test:e1", "test:e2"]).get_nodes()) == ["e1", "e2"] and doc.get_subgraph(["test:e1", "test:e2"]).get_edges().count() == 1
    chains = sorted(r.length for r in traverse.derivation_chains(doc.graph).filter("length > 1").collect())
    assert chains == [2, 3]
    critical = [[x.removeprefix("test:") for x in r.path] for r in doc.find_critical_paths().collect()]
    assert critical == [["main", "e2", "e3"]]


def test_cycles(doc):
    assert traverse.circular_dependencies(doc.graph).count() == 0
    loop = doc.add_edge("wasDerivedFrom", "test:e1", "test:e3")
    assert pairs(traverse.circular_dependencies(loop.graph), "a", "b") == [("e1", "e2"), ("e1", "e3"), ("e1", "main"), ("e2", "e3"), ("e2", "main"), ("e3", "main")]
    assert ids(loop.get_successors("test:e1"), "node") == ["e1", "e2", "e3", "main"]
    assert not metrics.graph_statistics(loop.graph, "doc").first().is_dag and metrics.graph_statistics(doc.graph, "doc").first().is_dag
    assert sorted(r.length for r in traverse.derivation_chains(loop.graph).collect()) == [1, 1, 3, 3, 3]


def test_connector_chains(base):
    d = base.add_edge("wasDerivedFrom", "test:fc1", "test:bc1")
    assert pairs(d.graph.view("doc")) == [("bc1", "fc1")]
    assert ids(d.get_precursors("test:fc1"), "node") == ["bc1"] and ids(d.get_successors_connectors("test:bc1"), "node") == ["fc1"]
    assert ids(d.get_related_connectors("test:bc1", "forward"), "node") == ["fc1"] and ids(d.get_related_connectors("test:fc1", "backward"), "node") == ["bc1"]
    assert ids(d.get_related_connectors("test:bc1", "both"), "node") == ["bc1", "fc1"]
    assert d.get_precursors("test:main").count() == 0


def test_metrics(doc):
    c = doc.analyze_document_complexity()
    assert (c["node_count"], c["edge_count"], c["average_degree"], c["component_count"]) == (8, 4, 1.0, 5) and c["density"] == pytest.approx(4 / 56)
    assert ids(c["hub_nodes"]) == ["e2"]
    g = doc.graph
    assert metrics.diameter(g).first()[0] == 2 and metrics.clustering(g).first()[0] == pytest.approx(1 / 3)
    assert {r.node_id[5:]: round(r.closeness, 4) for r in metrics.closeness(g).collect()} == {"e1": 0.75, "main": 0.6667, "e2": 1.0}
    assert metrics.betweenness(g).count() == 0
    assert {r.node_id[5:]: r.score for r in doc.compute_influence_scores().collect() if r.score} == {"e1": 5.5, "main": 3.0, "e2": 2.5}
    found = {(r.anomaly, r.node_id[5:]) for r in doc.detect_anomalies().collect()}
    assert {n for a, n in found if a == "isolated"} == {"bc1", "fc1", "sender", "receiver"} and {n for a, n in found if a == "high_degree"} == {"e1", "e2", "e3", "main"}
    assert not any(a == "broken_chain" for a, _ in found)


def test_priorities_and_order(doc):
    scores = {r.node_id[5:]: r.priority for r in doc.compute_node_priorities().collect()}
    assert scores == {"main": 103, "e1": 62, "e2": 15, "e3": 12, "bc1": 10, "fc1": 10, "sender": 10, "receiver": 10}
    order = [r.node_id[5:] for r in doc.get_execution_order().filter("component = 'test:e1'").orderBy("position").collect()]
    assert order == ["e1", "main", "e2", "e3"] and doc.get_execution_order().count() == 8
    assert schedule.violations(doc.graph, schedule.priorities(doc.graph)).count() == 3
    assert [r.node_id for r in doc.find_highest_priority_nodes(2).collect()] == ["test:main", "test:e1"]
    level = {r.node_id[5:]: r.level for r in schedule.topological_levels(doc.graph, "doc").collect()}
    assert (level["e1"], level["main"], level["e2"], level["e3"], level["sender"]) == (0, 1, 2, 3, 0)


def test_structure_and_rules(doc, base):
    buckets = [(r.bucket, r.code) for r in doc.validate_structure().collect()]
    assert sorted(buckets) == sorted([("errors", "backward_connector_not_used"), ("errors", "forward_connector_not_generated")] + [("info", "orphaned_node")] * 4)
    assert {r.bucket for r in doc.validate_constraints().collect()} == {"critical_errors"}
    assert "no_ti_nodes" in {r.code for r in ProvenanceDocument(traverse.subgraph_where(doc.graph, F.col("node_id").endswith("e1"))).validate_constraints().collect()}
    codes = {r.code for r in doc.validate().findings.collect()}
    assert codes == {"isolated_node", "graph_not_connected", "no_bundles"}
    ok = doc.add_edge("wasAssociatedWith", "test:main", "test:sender")
    assert validate.kind_constraints(ok.graph).count() == 0 and validate.kind_constraints(ok.graph, strict_reference=True).count() == 1
    bad = doc.add_edge("used", "test:e1", "test:main").add_edge("wasDerivedFrom", "test:e1", "test:e1")
    assert {"invalid_usage_relation", "self_loop_edge"} <= {r.code for r in bad.validate().errors().unionByName(bad.validate().warnings()).collect()}


def test_custom_rules(doc):
    v = validate.Validator({})
    v.add_rule(validate.rule_of(lambda g: g.nodes.filter("kind = 'agent'").select(F.lit("an agent").alias("message"), "node_id"), "INFO", name="agents"))
    v.add_rule(lambda g: g.nodes.select("no_such_column"), "broken")
    report = v.validate(doc.graph)
    assert report.counts.first().asDict() == {"error_count": 1, "warning_count": 0, "info_count": 2, "is_valid": False}
    v.remove_rule("broken")
    assert v.validate(doc.graph).is_valid


def test_edits(doc):
    assert "test:e2" not in {r.node_id for r in doc.remove_node("test:e2").get_nodes().collect()} and doc.remove_node("test:e2").get_edges().count() == 1
    renamed = doc.update_node_identifier("test:e2", "test:new")
    assert ("new", "e3") in pairs(renamed.get_edges()) and doc.update_node_identifier("test:e2", "test:new", keep_edges=False).get_edges().count() == 1
    assert renamed.get_prov_attribute("test:new", "attr:label").count() == 2
    with pytest.raises(InvalidOperationError):
        doc.add_node("entity", "test:e1")
    with pytest.raises(InvalidOperationError):
        doc.add_node("thing", "test:x")
    with pytest.raises(NodeNotFoundError):
        doc.add_edge("used", "test:main", "test:nope")
    with pytest.raises(NodeNotFoundError):
        doc.remove_node("test:nope")
    left, n = doc.remove_edges(relation_type="derivation")
    assert n == 2 and left.get_edges().count() == 2
    assert doc.remove_edge("test:e2", "test:e1").get_edges().count() == 3
    c = doc.add_node("entity", "test:set").set_collection_members("test:set", ["test:e1", "test:e2", "test:nope"])
    assert pairs(c.get_edges(relation_type="hadMember")) == [("set", "e1"), ("set", "e2")]
    c = c.set_collection_members("test:set", ["test:e3"])
    assert pairs(c.get_edges(relation_type="hadMember")) == [("set", "e3")]
    edge = doc.get_edges(relation_type="used").first().edge_id
    assert ("e3", "main") in pairs(doc.set_new_cause_and_effect(edge, "test:e3", "test:main").get_edges(relation_type="used"))
    assert len(doc.clear()) == 0


def test_merge_and_compare(doc, base):
    assert doc.equals(doc.clone(), strict=True) and not doc.equals(base) and doc.hash_code() == doc.clone().hash_code() != base.hash_code()
    other = ProvenanceDocument(edit.clear(base.graph)).add_node("entity", "test:e1", prov_type="ex:Other").add_node("entity", "test:only")
    kept = {p: doc.merge_with(other, p) for p in ("keep_first", "keep_second", "keep_both")}
    assert all(len(d) == 9 and d.get_edges().count() == 4 for d in kept.values())
    has_type = {p: d.get_node("test:e1").types != [] for p, d in kept.items()}
    assert has_type == {"keep_first": False, "keep_second": True, "keep_both": False}
    assert doc.merge_with(doc).equals(doc, strict=True)  # merging twice changes nothing
    united = merge.merge_graphs(doc.graph, other.graph)
    assert united.nodes.filter("node_id = 'test:e1'").first().types[0].local == "Other" and united.bundles.first()[0] == "ex:bundle"
    late = doc.filter_by_time_range("2025-01-01")
    assert "test:main" not in {r.node_id for r in late.get_nodes().collect()} and late.get_edges().count() == 2
    assert doc.filter_by_time_range("2023-01-01", "2030-01-01").equals(doc, strict=True)
    assert merge.difference(doc.graph, base.graph).count() == 4


def test_placeholders(spark):
    d = ProvenanceDocument.create_simple_graph(spark, ["a", "b", "c"], [("x", "a", "b"), ("y", "b", "c"), ("z", "a", "nope")])
    assert len(d) == 5 and d.get_edges().count() == 4
    s = ProvenanceDocument.create_simple_graph(spark, ["a", "b", "c"], [("x", "a", "b")]).get_graph_statistics()
    assert (s["num_nodes"], s["num_edges"], s["num_components"], s["is_dag"], s["max_degree"], s["min_degree"], s["average_degree"]) == (4, 2, 2, True, 2, 0, 1.0) and s["density"] == pytest.approx(1 / 6)


def test_betweenness_by_listing_paths(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(40)) if a != b})

    class Graph:
        def adjacency(self, view):
            return spark.createDataFrame(edges, "src string, dst string")

    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    total = {}
    for s in after:
        paths, front = {s: [[s]]}, [s]
        while front:
            new = {}
            for u in front:
                for v in after.get(u, []):
                    if v not in paths:
                        new.setdefault(v, []).extend([*p, v] for p in paths[u])
            paths |= new
            front = list(new)
        for t in set(after) & set(paths) - {s}:
            for p in paths[t]:
                for v in p[1:-1]:
                    total[v] = total.get(v, 0) + 1 / len(paths[t])
    n = len(after)
    got = {r.node_id: r.betweenness for r in metrics.betweenness(Graph()).collect()}
    assert got == {v: pytest.approx(x * 2 / ((n - 1) * (n - 2))) for v, x in total.items()}
