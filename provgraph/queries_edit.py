"""Registered queries over edits, connector chains, rarer paths and findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import ProvGraph
from .operators import edit, merge, traverse, validate
from .plans import fixpoint
from .queries import ORDER_SQL, _plain, query
from .sources import template
from .sources.build import all_of, edge_rows, graph_from, id_of, node_rows
from .sources.relational import order_graph

_EDGE = ("relation", "arg1", "arg2")


# --- edits -----------------------------------------------------------------------------------


@query("order", "z AS (SELECT 1) SELECT node_id, kind, coalesce(type, '') AS type FROM n WHERE kind = 'agent' UNION ALL SELECT 'nation:new', 'agent', 'CurrentAgent'")
def add_node(g):
    out = edit.add_node(g, "agent", "nation:new", {"name": "new"}, "cpm:CurrentAgent")
    return out.nodes.filter("kind = 'agent'").select("node_id", "kind", F.coalesce(F.get("types", F.lit(0))["local"], F.lit("")).alias("type"))


@query("order", """b AS (SELECT 'buyer:' || c_custkey AS node_id, 'cust:' || c_custkey AS cust FROM customer)
SELECT relation, arg1, arg2 FROM e UNION ALL SELECT 'delegation', node_id, cust FROM b""")
def add_many(g):
    """A buyer for every customer, added as a table of nodes and a table of relations."""
    cust = g.nodes.filter(F.col("node_id").startswith("cust:"))
    buyer = F.concat(F.lit("buyer:"), F.substring("node_id", 6, 100))
    out = edit.add_nodes(g, cust.select(buyer.alias("node_id"), F.lit("Agent").alias("kind")))
    return edit.add_edges(out, cust.select(F.lit("actedOnBehalfOf").alias("relation"), buyer.alias("arg1"), F.col("node_id").alias("arg2"))).edges.select(*_EDGE)


@query("order", "z AS (SELECT 1) SELECT relation, arg1, arg2 FROM e WHERE arg1 NOT LIKE 'supp:%' AND arg2 NOT LIKE 'supp:%'")
def remove_nodes(g):
    """Without all suppliers, given as a table."""
    return edit.remove_nodes_in(g, g.nodes.filter(F.col("node_id").startswith("supp:"))).edges.select(*_EDGE)


@query("order", "z AS (SELECT 1) SELECT relation, arg1, arg2 FROM e WHERE relation = 'delegation' AND arg1 <> 'region:1' AND arg2 <> 'region:1'")
def rename_node_without_edges(g):
    return edit.rename_node(g, "region:1", "region:one", keep_edges=False).edges.filter("relation = 'delegation'").select(*_EDGE)


@query("order", "z AS (SELECT 1) SELECT relation, arg1, arg2 FROM e WHERE relation = 'delegation' UNION ALL SELECT 'influence', 'nation:1', 'nation:2' UNION ALL SELECT 'derivation', 'region:2', 'region:3'")
def add_edge(g):
    """An influence in formal order, and a derivation from what causes to what results."""
    out = edit.add_edge(edit.add_edge(g, "wasInfluencedBy", "nation:1", "nation:2"), "wasDerivedFrom", "region:3", "region:2")
    return out.edges.filter("relation IN ('delegation', 'influence') OR arg1 LIKE 'region:%'").select(*_EDGE)


@query("order", "z AS (SELECT 1) SELECT relation, arg1, arg2 FROM e WHERE relation = 'delegation' UNION ALL SELECT unnest(['usage', 'influence']), 'region:1', 'region:2' UNION ALL SELECT 'communication', 'region:3', 'region:4'")
def build_edges(g):
    """A divided edge of two relations and a merged one of its first."""
    out = edit.EdgeBuilder().with_relations(["used", "wasInfluencedBy"]).with_cause("region:2").with_effect("region:1").build(g)
    out = edit.EdgeBuilder().with_relations(["wasInformedBy", "used"]).as_merged().with_cause("region:4").with_effect("region:3").with_identifier("ex:made").build(out)
    return out.edges.filter("relation = 'delegation' OR arg1 LIKE 'region:%'").select(*_EDGE)


@query("order", "z AS (SELECT 1) SELECT relation, arg1, arg2 FROM e WHERE NOT (relation = 'attribution' AND arg2 = 'supp:1')")
def remove_edges(g):
    """Without the attributions to one supplier, which is their source."""
    return edit.remove_edges(g, source="supp:1", relation="wasAttributedTo")[0].edges.select(*_EDGE)


@query("order", """k AS (SELECT min('usage|' || arg1 || '|' || arg2) AS k FROM e WHERE relation = 'usage')
SELECT relation, CASE WHEN 'usage|' || arg1 || '|' || arg2 = k THEN 'region:1' ELSE arg1 END AS arg1, CASE WHEN 'usage|' || arg1 || '|' || arg2 = k THEN 'region:2' ELSE arg2 END AS arg2 FROM e, k WHERE relation = 'usage'""")
def repoint_edge(g):
    """Other ends for the usage with the least id."""
    least = g.edges.filter("relation = 'usage'").agg(F.min("edge_id")).first()[0]
    return edit.repoint(g, least, "region:2", "region:1").edges.filter("relation = 'usage'").select(*_EDGE)


@query("order", "z AS (SELECT 1) SELECT CASE WHEN arg1 = 'nation:1' THEN 'nation:2' ELSE arg1 END AS arg1, CASE WHEN arg1 = 'nation:1' THEN 'region:4' ELSE arg2 END AS arg2 FROM e WHERE relation = 'delegation' AND arg2 LIKE 'region:%'")
def repoint_by_kind(g):
    """All delegations from a nation to its region, moved."""
    nation = g.edges.filter("arg1 = 'nation:1' AND arg2 LIKE 'region:%'").first()
    out = edit.repoint_by_kind(g, "actedOnBehalfOf", nation.arg2, "nation:1", "region:4", "nation:2")
    return out.edges.filter("relation = 'delegation' AND arg2 LIKE 'region:%'").select("arg1", "arg2")


@query("order", "z AS (SELECT 1) SELECT * FROM (VALUES ('region:0', 'nation:1'), ('region:0', 'nation:3')) v(arg1, arg2)")
def collection_members(g):
    """Members set twice: the second list replaces the first, what is no node is skipped."""
    out = edit.set_collection_members(edit.set_collection_members(g, "region:0", ["nation:1", "nation:2"]), "region:0", ["nation:3", "nowhere", "nation:1", "nation:3"])
    return out.edges.filter("relation = 'membership'").select("arg1", "arg2")


@query("order", "z AS (SELECT 1) SELECT node_id, kind, concat_ws(',', CASE WHEN kind = 'agent' THEN 'CurrentAgent' END, type) AS types FROM n")
def merge_duplicates(g):
    """Every agent is a record twice, with different types; one record with the types of both stays."""
    twice = g.nodes.filter("kind = 'agent'").withColumn("types", F.array(F.struct(F.lit("cpm").alias("prefix"), F.lit("CurrentAgent").alias("local"), F.lit("x").alias("uri"))))
    out = edit.merge_duplicates(g.with_(nodes=g.nodes.unionByName(twice)))
    return out.nodes.select("node_id", "kind", F.array_join(F.array_sort(F.transform("types", lambda t: t["local"])), ",").alias("types"))


@query("order", "z AS (SELECT 1) SELECT bundle_id, kind, count(*) AS n_nodes FROM n GROUP BY ALL UNION ALL SELECT 'bundle:more', 'entity', 1")
def graph_union(g):
    """Records keep their bundles; of an id in both graphs the first stays."""
    nodes = all_of(*[node_rows(g.spark.range(1), "bundle:more", F.lit(i), "entity") for i in ("region:1", "more:1")])
    return merge.union_graphs(g, graph_from(g.spark, nodes, g.edges.limit(0))).nodes.groupBy("bundle_id", "kind").agg(F.count("*").alias("n_nodes"))


# --- connector chains ------------------------------------------------------------------------


def _chain_graph(spark, sf_dir) -> ProvGraph:
    """Each order is a forward connector, derived from the one of the customer's order before and from its parts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = orders.select("o_orderkey", "o_custkey", before.alias("last"))
    nodes = all_of(
        node_rows(rows, "bundle:chain", id_of("fc", "o_orderkey"), "entity", "cpm:ForwardConnector", ordinal=F.col("o_orderkey")),
        node_rows(rows.select("o_custkey").distinct(), "bundle:chain", id_of("doc", "o_custkey"), "entity", ordinal=F.col("o_custkey")),
    )
    edges = all_of(
        edge_rows(rows.filter("last IS NOT NULL"), "bundle:chain", "derivation", id_of("fc", "o_orderkey"), id_of("fc", "last")),
        edge_rows(rows, "bundle:chain", "derivation", id_of("fc", "o_orderkey"), id_of("doc", "o_custkey")),
    )
    return graph_from(spark, nodes, edges)


_CHAIN = "WITH c AS (SELECT 'fc:' || o_orderkey AS id, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)\n"


def connector_precursors(spark, sf_dir):
    return traverse.precursors(_chain_graph(spark, sf_dir)).select("start", "node", "depth")


_plain(connector_precursors, _CHAIN + "SELECT x.id AS start, y.id AS node, (y.i - x.i)::INTEGER AS depth FROM c x JOIN c y ON x.k = y.k AND x.i < y.i")


def connector_successors(spark, sf_dir):
    return traverse.successor_connectors(_chain_graph(spark, sf_dir)).select("start", "node", "depth")


_plain(connector_successors, _CHAIN + "SELECT x.id AS start, y.id AS node, (x.i - y.i)::INTEGER AS depth FROM c x JOIN c y ON x.k = y.k AND x.i > y.i")


def related_connectors(spark, sf_dir):
    """In both directions mixed, a connector with a neighbour is related to itself."""
    return traverse.related_connectors(_chain_graph(spark, sf_dir)).groupBy("start").agg(F.count("*").alias("n_related"), F.max("depth").alias("farthest"))


_plain(related_connectors, _CHAIN + "SELECT start, n_related, greatest(far, 2)::INTEGER AS farthest FROM (SELECT x.id AS start, count(*) AS n_related, max(abs(x.i - y.i)) AS far FROM c x JOIN c y ON x.k = y.k GROUP BY x.id HAVING count(*) > 1)")


# --- paths -----------------------------------------------------------------------------------


@query("order", "z AS (SELECT 1) SELECT relation, arg1, arg2 FROM e WHERE relation IN ('association', 'delegation') AND arg1 NOT LIKE 'supp:%'")
def subgraph_by_ids(g):
    """Induced on a table of ids, for two kinds of relations."""
    ids = g.nodes.filter("kind = 'activity' OR kind = 'agent' AND node_id NOT LIKE 'supp:%'")
    return traverse.subgraph(g, ids, ["wasAssociatedWith", "actedOnBehalfOf"]).edges.select(*_EDGE)


@query("order", """p AS (SELECT 'order:' || o_orderkey AS source, concat_ws(' ', 'order:' || o_orderkey, 'cust:' || c_custkey, 'nation:' || n_nationkey, 'region:' || n_regionkey) AS path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT source, path FROM p""")
def critical_paths(g):
    """The longest paths from every order over what it makes and whom it is for."""
    some = g.with_(edges=g.edges.filter("relation IN ('generation', 'association', 'delegation')"))
    return traverse.critical_paths(some).select("source", F.array_join("path", " ").alias("path"))


@query("order", """p AS (SELECT 'cust:' || c_custkey AS source, 'supp:' || s_suppkey AS target, concat_ws(' ', 'cust:' || c_custkey, 'nation:' || c_nationkey, 'supp:' || s_suppkey) AS path
  FROM customer JOIN supplier ON c_nationkey = s_nationkey) SELECT source, target, path FROM p""")
def undirected_paths(g):
    """From customers to the suppliers of their nation, along delegations in either direction."""
    some = g.with_(edges=g.edges.filter("relation = 'delegation'")).materialized("edges")
    of = lambda end, prefix: some.edges.filter(F.col("arg1").startswith(prefix)).select(F.col("arg1").alias(end), F.col("arg2").alias("group"))
    return traverse.undirected_paths_in_groups(some, of("source", "cust:"), of("target", "supp:"), sep=" ")


@query("transition", """o AS (SELECT min(node_id) AS s, count(*) AS k FROM n),
r AS (SELECT s AS t, 0 AS depth FROM o UNION SELECT dst, depth + 1 FROM r JOIN a ON t = src, o WHERE depth < k),
d AS MATERIALIZED (SELECT t, min(depth) AS depth FROM r GROUP BY t),
p AS (SELECT s AS t, [s] AS path FROM o UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN a ON p.t = src JOIN d ON d.t = dst WHERE d.depth = len(path))
SELECT t AS target, array_to_string(path, ' ') AS path FROM p WHERE len(path) > 1""")
def shortest_paths(g):
    """All shortest paths from the first node. In SQL a path goes on only to nodes one step farther away."""
    first = g.nodes.agg(F.min("node_id").alias("node"))
    return fixpoint.shortest_paths(g.adjacency("doc"), first).select(F.col("node").alias("target"), F.array_join("path", " ").alias("path"))


# --- findings --------------------------------------------------------------------------------

_FAULTY = ORDER_SQL.rstrip().rstrip(",") + """,
g0 AS (SELECT relation, arg1, arg2 FROM e WHERE relation = 'delegation'
  UNION ALL SELECT 'delegation', 'nation:' || n_nationkey, 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'usage', 'cust:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'generation', 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'association', 'region:' || r_regionkey, 'nowhere:' || r_regionkey FROM region),
m0 AS (SELECT node_id, kind FROM n WHERE kind = 'agent' UNION ALL SELECT 'part:' || p_partkey, 'entity' FROM part UNION ALL SELECT 'nowhere:' || r_regionkey, 'unknown' FROM region),
w AS (SELECT relation, arg1, arg2, arg2 AS cause, arg1 AS effect, relation || '|' || arg1 || '|' || arg2 AS edge_id FROM g0),
lost AS (SELECT node_id FROM m0 WHERE node_id NOT IN (SELECT arg1 FROM g0) AND node_id NOT IN (SELECT arg2 FROM g0)),
u AS (SELECT cause AS x, effect AS y FROM w UNION SELECT effect, cause FROM w),
first AS (SELECT node_id AS x FROM (SELECT node_id, ordinal FROM n WHERE kind = 'agent' UNION ALL SELECT 'part:' || p_partkey, p_partkey FROM part UNION ALL SELECT 'nowhere:' || r_regionkey, 0 FROM region) ORDER BY ordinal, node_id LIMIT 1),
c AS (SELECT x FROM first UNION SELECT u.y FROM c JOIN u USING (x)),
cap AS (SELECT w.*, upper(x.kind[1]) || x.kind[2:] || ' -> ' || upper(y.kind[1]) || y.kind[2:] AS got FROM w JOIN m0 x ON x.node_id = cause JOIN m0 y ON y.node_id = effect)
"""


def _faulty_graph(spark, sf_dir) -> ProvGraph:
    """The agents of the order graph with faults: loops, ends of wrong kinds, undeclared ends, parts without
    any relation, an id with two kinds, a bundle without records.
    """
    g = order_graph(spark, sf_dir)
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nodes = all_of(
        g.nodes.filter("kind = 'agent'"), node_rows(t("part"), "bundle:parts", id_of("part", "p_partkey"), "entity", ordinal=F.col("p_partkey")),
        node_rows(t("region"), "bundle:agents", id_of("region", "r_regionkey"), "entity", ordinal=F.col("r_regionkey") + 1_000_000),
    )
    edges = all_of(
        g.edges.filter("relation = 'delegation'"), edge_rows(t("nation"), "bundle:agents", "delegation", id_of("nation", "n_nationkey"), id_of("nation", "n_nationkey")),
        edge_rows(t("customer"), "bundle:agents", "usage", id_of("cust", "c_custkey"), id_of("nation", "c_nationkey")), edge_rows(t("supplier"), "bundle:agents", "generation", id_of("supp", "s_suppkey"), id_of("nation", "s_nationkey")),
        edge_rows(t("region"), "bundle:agents", "association", id_of("region", "r_regionkey"), id_of("nowhere", "r_regionkey")),
    )
    out = graph_from(spark, nodes, edges)
    return out.with_(bundles=out.bundles.union(spark.createDataFrame([("bundle:empty",)], "bundle_id string")))


def findings(spark, sf_dir):
    """All rules on a graph with faults: every finding with its text and what it is about."""
    found = validate.validate(_faulty_graph(spark, sf_dir), _demanding(spark)).findings
    return found.select("level", "code", "message", F.coalesce("node_id", "edge_id", "bundle_id", F.lit("")).alias("subject"))


def _demanding(spark) -> DataFrame:
    b = template.TemplateBuilder("test:wanted").with_main_activity("test:main").with_backward_connector("test:b").with_forward_connector("test:f")
    return b.build(spark)


_plain(findings, _FAULTY + """
SELECT 'ERROR' AS level, 'node_no_elements' AS code, 'Node has no elements' AS message, node_id AS subject FROM m0 WHERE kind = 'unknown'
UNION ALL SELECT 'WARNING', 'isolated_node', 'Isolated node detected', node_id FROM lost
UNION ALL SELECT 'WARNING', 'self_loop_edge', 'Self-loop edge detected', edge_id FROM w WHERE cause = effect
UNION ALL SELECT 'ERROR', 'invalid_usage_relation', 'Invalid Usage relation: expected Entity -> Activity, got ' || got, edge_id FROM cap WHERE relation = 'usage'
UNION ALL SELECT 'ERROR', 'invalid_generation_relation', 'Invalid Generation relation: expected Activity -> Entity, got ' || got, edge_id FROM cap WHERE relation = 'generation'
UNION ALL SELECT 'ERROR', 'invalid_association_relation', 'Invalid Association relation: expected Activity -> Agent, got ' || got, edge_id
  FROM (SELECT edge_id, 'Unknown -> ' || k AS got FROM w, (VALUES ('Agent'), ('Entity')) v(k) WHERE relation = 'association')
UNION ALL SELECT 'WARNING', 'empty_bundle', 'Empty bundle detected', 'bundle:empty'
UNION ALL SELECT 'WARNING', 'inconsistent_node_types', 'Node has elements with inconsistent types: agent, entity', 'region:' || r_regionkey FROM region
UNION ALL SELECT 'ERROR', 'graph_not_connected', 'Graph not fully connected: ' || count(*) FILTER (node_id IN (SELECT x FROM c)) || '/' || count(*) || ' nodes reachable', ''
  FROM (SELECT node_id FROM m0 UNION ALL SELECT 'region:' || r_regionkey FROM region)
UNION ALL SELECT 'ERROR', 'template_missing_main_activity', 'Missing required main activity', ''
UNION ALL SELECT 'WARNING', 'template_missing_backward_connectors', 'Template specifies backward connectors but none found in graph', ''
UNION ALL SELECT 'WARNING', 'template_missing_forward_connectors', 'Template specifies forward connectors but none found in graph', ''
""")
