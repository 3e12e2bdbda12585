"""Work that grows with what a query says, not with all pairs, copies or scans of its tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from provgraph.operators import metrics, traverse
from provgraph.plans import fixpoint, scratch
from provgraph.sinks import export
from provgraph.sources import formats, jsonld

from .test_sizes import _graph


def _depths(edges):
    """{start: {node: depth}} by breadth-first search; a start is in it if it lies on a cycle."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
    out = {}
    for s in near:
        seen, front, depth = {}, near[s], 0
        while front:
            depth += 1
            seen |= dict.fromkeys(front, depth)
            front = {y for x in front for y in near.get(x, ())} - set(seen)
        out[s] = seen
    return out


@pytest.mark.parametrize("near", [2, 16])
def test_reach_counts_against_search(spark, monkeypatch, near):
    """Chains that end, fork, merge, run into a cycle or lie on one; loops and doubled edges; far ways are doubled."""
    monkeypatch.setattr(fixpoint, "NEAR", near)
    rng = random.Random(3)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    odd = [("m", "c4"), ("f", "c0"), ("f", "x"), ("g", "f"), ("h", "h"), ("h", "c8"), ("c1", "c2"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t", "r1"), ("u", "t")]
    mixed = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(26)]
    for edges in (chain + odd + mixed, [("r1", "r2"), ("r2", "r1"), ("a", "a")]):
        table, want = spark.createDataFrame(edges, "src string, dst string"), _depths(edges)
        got = sorted(tuple(r) for r in fixpoint.reach_counts(table).select("start", "n_reached", "farthest", "total").collect())
        assert got == sorted((s, len(d), max(d.values()), sum(d.values())) for s, d in want.items())
    if near == 2:
        others = {s: [k for n, k in d.items() if n != s] for s, d in want.items()}
        close = {r.node_id: r.closeness for r in metrics.closeness(_graph(spark, edges)).collect()}
        assert close == {s: pytest.approx(len(d) / sum(d)) for s, d in others.items()}


def test_a_chain_is_counted_without_its_pairs(spark):
    before = len(scratch._SCRATCH)
    found = fixpoint.reach_counts(spark.range(600).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst")))
    assert found.agg(F.sum("n_reached")).first()[0] == 600 * 601 // 2
    assert all(spark.read.parquet(p).count() <= 600 for _, p in scratch._SCRATCH[before:])


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_storage_bundles_shuffle_no_texts(spark):
    """Nodes of an opened bundle count by their place; texts of one document meet; an id stays once, at its first place; broken texts have the fixed nodes."""
    p = lambda k: {"@id": f"https://o/p{k}", "@type": "Person", "name": f"N{k}"}
    o = [{"@id": f"_:{k}", "@type": ["sosa:Observation"]} for k in (1, 2, 2, 3, 4, 5)]
    texts = [("a", {"@graph": [p(1), *o, {"@id": "b", "@graph": [{"@id": "_:s", "@type": "Sample"}, {"@type": "Sample"}, p(0)]}]}), ("a", {"@graph": [{"@id": "x"}, p(2)]}), ("b", "{no json"), ("c", {"@graph": []})]
    rows = spark.createDataFrame([(d, t if isinstance(t, str) else json.dumps(t)) for d, t in texts], "doc string, value string")
    g = jsonld.storage_bundles(rows)
    plan = _plan(g.nodes)
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((r.bundle_id, r.node_id, r.kind, r.types[0].local, r.ordinal) for r in g.nodes.collect())
    fixed = [(f"embrc:{d}_storage", f"embrc:{d}_{x}", "activity" if x == "mainActivity" else "entity", x, 0) for d in "abc" for x in ("mainActivity", "backwardConnector", "forwardConnector")]
    own = [("o_p1", "agent", "senderAgent", 0), ("o_p2", "agent", "senderAgent", 1), ("sample_s", "entity", "Sample", 0), ("", "entity", "Sample", 1)] + [(f"obs_{k}", "entity", "Observation", place) for k, place in ((1, 1), (2, 2), (3, 4), (4, 5))]
    assert got == sorted(fixed + [("embrc:a_storage", f"embrc:{i}", *r) for i, *r in own])
    names = sorted((r.record_id, r.name, r.value) for r in g.attrs.filter("value NOT LIKE '% Processing'").collect())
    assert names == sorted([("embrc:o_p1", "schema:name", "N1"), ("embrc:o_p2", "schema:name", "N2"), *[(f"embrc:{i}", f"schema:{n}", v) for i in ("sample_s", "") for n, v in (("name", "Unknown Sample"), ("description", ""))]])
    assert g.edges.count() == 9


def test_ntriples_are_parsed_once_and_joined_once(spark):
    """Ends without a kind are placeholders, whatever else is said of them; the writer groups no attributes."""
    prov, rdf = "http://www.w3.org/ns/prov#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    said = [("a", rdf, f"<{prov}Activity>"), ("a", rdf, "<http://t/T>"), ("a", f"{prov}startedAtTime", '"2024-01-02T03:04:05"'), ("a", f"{prov}used", "<x:e>"), ("a", f"{prov}used", "<x:e>"), ("e", rdf, f"<{prov}Entity>"), ("a", f"{prov}used", "<x:odd>"), ("odd", rdf, "<http://t/U>"), ("lone", rdf, "<http://t/U>"), ("odd", f"{prov}endedAtTime", '"2024-01-02T03:04:05"'), ("a", "x:note", '"n"')]
    before = len(scratch._SCRATCH)
    g = formats.ntriples_graph(spark.createDataFrame([(f"<x:{s}> <{p}> {o} .",) for s, p, o in said], "value string"))
    assert [p.rpartition("/")[2].rpartition("-")[0] for _, p in scratch._SCRATCH[before:]] == ["ntriples"]
    plan = _plan(g.nodes)
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    assert sorted((r.node_id, r.kind, [t.local for t in r.types], r.start_time is not None, r.end_time is not None, r.is_placeholder) for r in g.nodes.collect()) == [("x:a", "activity", ["T"], True, False, False), ("x:e", "entity", [], False, False, False), ("x:odd", "unknown", [], False, False, True)]
    assert g.edges.count() == 2 and [r.value for r in g.attrs.filter("name = 'x:note'").collect()] == ["n"]
    lines = export.ntriples(g)
    assert "collect_list" not in _plan(lines)
    again = f'<http://example.org/x/a> <{prov}startedAtTime> "2024-01-02T03:04:05" .'  # read as an attribute too
    assert sorted(r.value for r in lines.collect()) == sorted([again] + [f"<x:{s}> <{p}> {o} .".replace("<x:", "<http://example.org/x/").replace('5" .', '5"^^<http://www.w3.org/2001/XMLSchema#dateTime> .') for s, p, o in dict.fromkeys(said) if s not in ("odd", "lone")])


def test_paths_keep_only_edges_between_nodes_on_the_way(spark):
    """Doubled edges and edges that lead nowhere are written once as they are read, and not again with the ways."""
    edges = [("a", "b"), ("a", "b"), ("b", "t"), ("a", "t")] + [(f"x{i}", f"y{i}") for i in range(50)] + [("b", "y1")]
    before = len(scratch._SCRATCH)
    found = traverse.find_paths(_graph(spark, edges), spark.createDataFrame([("a", "t"), ("x1", "t")], "source string, target string"), 4)
    assert sorted(r.path for r in found.collect()) == [["a", "b", "t"], ["a", "t"]]
    made = [(p.rpartition("/")[2].rpartition("-")[0], spark.read.parquet(p).count()) for _, p in scratch._SCRATCH[before:]]
    assert [n for name, n in made if name == "path-edges"] == [55, 3] and "reach-edges" not in dict(made)


def test_degrees_are_counted_in_one_grouping(spark):
    """Loops, doubled and opposite edges, doubled records, lone nodes and ids that are null."""
    edges = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", "e"), ("e", "f")]
    g = _graph(spark, edges, ["z"], ["a", None])
    for view in ("doc", "wrap"):
        found = metrics.degree_distribution(g, view)
        assert _plan(found).count("Exchange hashpartitioning") == 3 and "Join" not in _plan(found)
        assert sorted(tuple(r) for r in found.collect()) == [(0, 3), (1, 2), (2, 4)]
