"""Registered queries over look-ups, edge predicates, loading, names, templates and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .document import ProvenanceDocument
from .functions.names import normal_datetime, resolve
from .functions.types import types_of
from .graph import ProvGraph
from .operators import edit, merge, select, templates, traverse, validate
from .queries import _order_templates, _plain, query
from .queries_edit import _chain_graph
from .sources import jsonld, template
from .sources.build import all_of, edge_rows, graph_from, id_of, node_rows
from .sources.relational import order_graph

_Z = "z AS (SELECT 1) "
_EDGE = ("relation", "arg1", "arg2")


def _read(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(**rows: DataFrame) -> DataFrame:
    """All tables under each other, with the name of each in ``what``."""
    return all_of(*[r.withColumn("what", F.lit(name)) for name, r in rows.items()])


# --- nodes -----------------------------------------------------------------------------------


@query("order", _Z + "SELECT node_id, kind, bundle_id FROM n WHERE node_id = 'nation:3'")
def nodes_by_id(g):
    return select.nodes_by_id(g, "nation:3").select("node_id", "kind", "bundle_id")


@query("order", _Z + "SELECT w AS wanted, node_id, kind FROM (VALUES ('nation:3'), ('nation:none')) v(w) LEFT JOIN n ON node_id = w")
def single_node(g):
    """One record or none."""
    found = [(wanted, select.node(g, wanted)) for wanted in ("nation:3", "nation:none")]
    return g.spark.createDataFrame([(w, r and r.node_id, r and r.kind) for w, r in found], "wanted string, node_id string, kind string")


@query("order", _Z + """SELECT 'element' AS what, node_id, kind FROM n WHERE node_id = 'region:1' AND kind = 'agent' AND bundle_id = 'bundle:agents'
UNION ALL SELECT 'kind', node_id, kind FROM n WHERE node_id = 'region:1' AND kind = 'agent'""")
def nodes_by_element(g):
    """By a whole record and by id and kind: one hit each; the same id in another bundle or of another kind is none."""
    found = _labelled(
        element=select.nodes_by_element(g, "region:1", "agent", "bundle:agents"), elsewhere=select.nodes_by_element(g, "region:1", "agent"),
        kind=select.nodes_by_id_and_kind(g, "region:1", "Agent"), other_kind=select.nodes_by_id_and_kind(g, "region:1", "entity"),
    )
    return found.select("what", "node_id", "kind")


@query("order", _Z + "SELECT node_id, CASE WHEN kind = 'agent' THEN 2 ELSE 1 END AS n_records, CASE WHEN kind = 'agent' THEN 'agent entity' ELSE kind END AS kinds FROM n")
def nodes_map(g):
    """All records of every id; each agent is declared as an entity as well."""
    twice = g.nodes.filter("kind = 'agent'").withColumn("kind", F.lit("entity"))
    by = select.nodes_map(g.with_(nodes=g.nodes.unionByName(twice)))
    return by.select("node_id", F.size("records").alias("n_records"), F.array_join(F.array_sort(F.transform("records", lambda r: r["kind"])), " ").alias("kinds"))


@query("order", _Z + "SELECT node_id, strftime(start_time, '%Y-%m-%d') AS start_day, ordinal = min(ordinal) OVER () AS is_first FROM n WHERE type = 'MainActivity'")
def main_activities(g):
    """All main activities and which is the document's: the first by arrival."""
    first = select.main_activity(g).select(F.col("node_id").alias("first"))
    rows = select.main_activities(g).join(first, F.col("node_id") == F.col("first"), "left")
    return rows.select("node_id", F.date_format("start_time", "yyyy-MM-dd").alias("start_day"), F.col("first").isNotNull().alias("is_first"))


def connectors(spark, sf_dir):
    """Connectors of both directions and current agents, by their types; nations are made current agents here."""
    g = order_graph(spark, sf_dir)
    current = g.with_(nodes=g.nodes.withColumn("types", F.when(F.col("node_id").startswith("nation:"), types_of("cpm:CurrentAgent")).otherwise(F.col("types"))))
    found = _labelled(forward=select.forward_connectors(_chain_graph(spark, sf_dir)), backward=select.backward_connectors(g), current=select.current_agents(current), none=select.forward_connectors(g))
    return found.select("what", "node_id")


_plain(connectors, """SELECT 'forward' AS what, 'fc:' || o_orderkey AS node_id FROM orders UNION ALL SELECT 'backward', 'part:' || p_partkey FROM part
UNION ALL SELECT 'current', 'nation:' || n_nationkey FROM nation""")


@query("order", _Z + "SELECT node_id FROM n WHERE type = 'SenderAgent'")
def nodes_by_exact_type(g):
    """By the type's full name; a local name or another case is no exact match."""
    other = [select.nodes_by_exact_type(g, u) for u in ("SenderAgent", f"{S.CPM_URI}senderagent")]
    return all_of(select.nodes_by_exact_type(g, f"{S.CPM_URI}SenderAgent"), *other).select("node_id")


@query("order", _Z + "SELECT what, value FROM (UNPIVOT (SELECT o_orderpriority AS priority, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 1) ON priority, status INTO NAME what VALUE value)")
def attribute_values(g):
    """Values of attributes of the last order."""
    last = g.nodes.filter("kind = 'activity'").agg(F.max_by("node_id", "ordinal")).first()[0]
    return _labelled(**{name: select.attribute_values(g, last, f"attr:{name}") for name in ("priority", "status", "none")}).select("what", "value")


@query("order", _Z + """SELECT 'any' AS what, relation, arg1, arg2 FROM e WHERE 'nation:3' IN (arg1, arg2) UNION ALL SELECT 'cause', relation, arg1, arg2 FROM e WHERE arg2 = 'nation:3'
UNION ALL SELECT 'effect', relation, arg1, arg2 FROM e WHERE arg1 = 'nation:3' AND relation = 'delegation'""")
def incident_edges(g):
    """Edges at a node on either side, where it is the cause, and of a kind where it is the effect."""
    at = lambda *how: select.incident_edges(g, "nation:3", *how)
    return _labelled(any=at(), cause=at("cause"), effect=at("effect", "PROV_DELEGATION"), none=at("any", "used")).select("what", *_EDGE)


@query("order", _Z + """SELECT 'out' AS what, effect AS node_id FROM e WHERE cause = 'part:7' UNION SELECT 'in', cause FROM e WHERE effect = 'part:7'
UNION SELECT 'both', CASE WHEN cause = 'part:7' THEN effect ELSE cause END FROM e WHERE 'part:7' IN (cause, effect)""")
def neighbours(g):
    """One hop along, against and in both directions of the edges of one part."""
    return _labelled(**{way: select.neighbours(g, "part:7", way) for way in ("out", "in", "both")}).select("what", "node_id")


@query("order", _Z + "SELECT count(*) AS n_nodes FROM n")
def graph_size(g):
    return g.spark.createDataFrame([(g.count(),)], "n_nodes long")


# --- edges -----------------------------------------------------------------------------------


@query("order", _Z + """SELECT what, arg1, arg2 FROM (VALUES ('along'), ('swapped'), ('of_kind')) v(what), e WHERE arg1 = 'nation:1' AND relation = 'delegation'
UNION ALL SELECT unnest(['swapped_of_kind', 'none']), NULL, NULL""")
def single_edge(g):
    """The only edge between two nodes; only without a kind are its ends tried the other way round."""
    region = g.edges.filter("arg1 = 'nation:1'").first().arg2
    found = {
        "along": select.edge(g, "nation:1", region), "swapped": select.edge(g, region, "nation:1"), "of_kind": select.edge(g, "nation:1", region, "actedOnBehalfOf"),
        "swapped_of_kind": select.edge(g, region, "nation:1", "actedOnBehalfOf"), "none": select.edge(g, "nation:1", "nation:2"),
    }
    return g.spark.createDataFrame([(k, r and r.src, r and r.dst) for k, r in found.items()], "what string, arg1 string, arg2 string")


@query("order", _Z + "SELECT what, relation, arg1, arg2 FROM (VALUES ('id'), ('id_and_kind'), ('relation')) v(what), e WHERE arg1 = 'nation:1' AND relation = 'delegation'")
def edges_by_id(g):
    """By id, by id and kind, by kind and both formal arguments; another kind or swapped arguments are no match."""
    one = g.edges.filter("arg1 = 'nation:1'").first()
    found = _labelled(
        id=select.edges_by_id(g, one.edge_id), id_and_kind=select.edge_with_kind(g, one.edge_id, "actedOnBehalfOf"), id_and_other=select.edge_with_kind(g, one.edge_id, "used"),
        relation=select.edges_by_relation(g, "actedOnBehalfOf", one.arg1, one.arg2), swapped=select.edges_by_relation(g, "actedOnBehalfOf", one.arg2, one.arg1), node_id=select.edges_by_id(g, "nation:1"),
    )
    return found.select("what", *_EDGE)


@query("order", """d AS (SELECT * FROM e WHERE relation = 'delegation')
SELECT 'cause' AS what, relation, arg1, arg2 FROM e WHERE cause = 'supp:1' UNION ALL SELECT 'effect', relation, arg1, arg2 FROM e WHERE effect = 'supp:1' UNION ALL SELECT 'kind', relation, arg1, arg2 FROM e WHERE relation = 'association'
UNION ALL SELECT 'ends', relation, arg1, arg2 FROM e WHERE cause = 'region:1' AND effect = 'nation:1' UNION ALL SELECT 'node', relation, arg1, arg2 FROM e WHERE 'supp:1' IN (cause, effect)
UNION ALL SELECT 'attribute', relation, arg1, arg2 FROM d UNION ALL SELECT 'value', relation, arg1, arg2 FROM d WHERE arg2 = 'region:2'""")
def edge_filters(g):
    """Wrap-view edges by each filter. Every delegation gets an attribute: for whom it is."""
    own = g.edges.filter("relation = 'delegation'").select(F.col("edge_id").alias("record_id"), F.lit("edge").alias("record_class"), F.lit("attr:for").alias("name"), F.col("arg2").alias("value"), F.lit("string").alias("value_type"), F.lit(0).cast("long").alias("ordinal"))
    h = g.with_(attrs=g.attrs.unionByName(own))
    found = {"cause": {"cause": "supp:1"}, "effect": {"effect": "supp:1"}, "kind": {"kind": "wasAssociatedWith"}, "ends": {"cause": "region:1", "effect": "nation:1"}, "node": {"node_id": "supp:1"}, "attribute": {"attribute": "attr:for"}, "value": {"attribute": "attr:for", "value": "region:2"}}
    return _labelled(**{name: select.edges_where(h, **how) for name, how in found.items()}).select("what", *_EDGE)


@query("order", _Z + "SELECT relation, cause, effect, CASE WHEN cause = 'nation:3' THEN effect WHEN effect = 'nation:3' THEN cause END AS other FROM e WHERE relation = 'delegation'")
def other_ends(g):
    """The other end of every delegation, as seen from one nation; null where it is no end."""
    return g.directed.filter("relation = 'delegation'").select("relation", "cause", "effect", select.other_node("nation:3").alias("other"))


@query("order", _Z + "SELECT relation, effect AS src, cause AS dst FROM e")
def reversed_edges(g):
    return select.reversed_edges(g).select("relation", "src", "dst")


# --- loading and copies ----------------------------------------------------------------------


def _scanned(spark, sf_dir) -> ProvGraph:
    """Records with repeated ids of two kinds, and relations to parts, of which only the even ones are declared."""
    lines = _read(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    kinds = [node_rows(rows.filter(test), "bundle:lines", id_of("order", "l_orderkey"), kind, ordinal=F.col("l_linenumber")) for kind, test in (("activity", "l_linenumber % 2 = 1"), ("agent", "l_linenumber % 2 = 0"))]
    parts = node_rows(_read(spark, sf_dir, "part").filter("p_partkey % 2 = 0"), "bundle:parts", id_of("part", "p_partkey"), "entity")
    edges = edge_rows(rows, "bundle:lines", "usage", id_of("order", "l_orderkey"), id_of("part", "l_partkey"), ordinal=F.col("l_linenumber"))
    return graph_from(spark, all_of(*kinds, parts), edges, dedupe=True)


def load_records(spark, sf_dir):
    """Of records with one id the first by arrival stays; ids that no record declares get a placeholder."""
    return _scanned(spark, sf_dir).nodes.select("node_id", "kind", "is_placeholder")


_LINES = "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber), d AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 2 = 0)\n"
_plain(load_records, _LINES + """SELECT 'order:' || k AS node_id, CASE WHEN min(i) % 2 = 1 THEN 'activity' ELSE 'agent' END AS kind, false AS is_placeholder FROM l GROUP BY k
UNION ALL SELECT 'part:' || p, 'entity', false FROM d UNION ALL SELECT DISTINCT 'part:' || p, 'unknown', true FROM l WHERE p NOT IN (SELECT p FROM d)""")


def undeclared_ends(spark, sf_dir):
    """Relations with an end that no record declares."""
    return select.unmapped_edges(_scanned(spark, sf_dir)).select("arg1", "arg2", F.col("ordinal").alias("line"))


_plain(undeclared_ends, _LINES + "SELECT 'order:' || k AS arg1, 'part:' || p AS arg2, i::BIGINT AS line FROM l WHERE p NOT IN (SELECT p FROM d)")


@query("order", """u AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM items WHERE l_partkey <> 7)
SELECT 'supp:' || l_suppkey AS source, concat_ws(' ', 'supp:' || l_suppkey, 'item:' || l_orderkey || ':' || l_linenumber, 'part:7') AS path FROM items WHERE l_partkey = 7
UNION ALL SELECT 'supp:' || x.l_suppkey, concat_ws(' ', 'supp:' || x.l_suppkey, 'item:' || x.l_orderkey || ':' || x.l_linenumber, 'part:' || p, 'order:' || o, 'item:' || y.l_orderkey || ':' || y.l_linenumber, 'part:7')
  FROM items x JOIN u ON x.l_partkey = p JOIN items y ON y.l_orderkey = o AND y.l_partkey = 7""")
def branching_paths(g):
    """All simple paths of at most six nodes from every supplier to one part: over its items, or another part and an order that uses both."""
    pairs = g.nodes.filter(F.col("node_id").startswith("supp:")).select(F.col("node_id").alias("source"), F.lit("part:7").alias("target"))
    return traverse.find_paths(g, pairs, 6).select("source", F.array_join("path", " ").alias("path"))


@query("order", _Z + "SELECT what, kind, count(*) - CASE WHEN what = 'edited' AND kind = 'agent' THEN 5 ELSE 0 END AS n_nodes FROM n, (VALUES ('original'), ('edited')) v(what) GROUP BY what, kind")
def clone_graph(g):
    """A copy that is edited leaves the original as it was."""
    copy = merge.clone(g)
    edited = edit.remove_nodes_in(copy, copy.nodes.filter(F.col("node_id").startswith("region:")))
    return _labelled(original=g.nodes, edited=edited.nodes).groupBy("what", "kind").agg(F.count("*").alias("n_nodes"))


@query("order", """s AS (SELECT * FROM e WHERE relation IN ('generation', 'derivation')), g0 AS (SELECT cause, effect, count(*) AS k, string_agg(DISTINCT relation, ',' ORDER BY relation) AS r FROM s GROUP BY cause, effect)
SELECT 'divided' AS what, cause, effect, 1::BIGINT AS n_relations, relation AS relations FROM s UNION ALL SELECT 'merged', cause, effect, k, r FROM g0""")
def subgraph_groupings(g):
    """The subgraph of activities and entities without usages, its edges divided and merged."""
    sub = traverse.subgraph(g, g.nodes.filter("kind <> 'agent'"), ["wasGeneratedBy", "wasDerivedFrom"])
    rows = {mode: merge.grouped_edges(sub, mode) for mode in ("divided", "merged")}
    return _labelled(**rows).select("what", F.col("src").alias("cause"), F.col("dst").alias("effect"), "n_relations", F.array_join("relations", ",").alias("relations"))


@query("order", """d AS (SELECT arg1 AS x FROM e WHERE relation = 'delegation' UNION SELECT arg2 FROM e WHERE relation = 'delegation')
SELECT node_id, kind FROM n WHERE node_id NOT IN (SELECT x FROM d)""")
def isolated_without_lines(g):
    """What no relation holds once only delegations are left."""
    return select.isolated_nodes(g.with_(edges=g.edges.filter("relation = 'delegation'"))).select("node_id", "kind")


@query("order", _Z + """SELECT 'moved' AS what, 'bundle:one' AS bundle_id, kind, count(*) AS n_records FROM n GROUP BY kind UNION ALL SELECT 'moved', 'bundle:one', relation, count(*) FROM e GROUP BY relation
UNION ALL SELECT 'added', 'usage', arg2, 1 FROM (VALUES ('region:1'), ('region:2')) v(arg2) UNION ALL SELECT 'added', 'generation', 'region:3', 1""")
def bundle_edits(g):
    """All records under another bundle id, a new activity with what it uses and makes, and a document that is cleared."""
    count = lambda rows, kind: rows.groupBy("bundle_id", F.col(kind).alias("kind")).agg(F.count("*").alias("n_records"))
    moved, gone = edit.set_bundle_id(g, "bundle:one"), edit.clear(g)
    new = edit.add_activity(g, "act:new", ["region:1", "region:2"], ["region:3"]).edges.filter("'act:new' IN (arg1, arg2)")
    added = new.select(F.col("relation").alias("bundle_id"), F.when(F.col("arg1") == "act:new", F.col("arg2")).otherwise(F.col("arg1")).alias("kind"), F.lit(1).cast("long").alias("n_records"))
    moved_rows = count(moved.nodes, "kind").unionByName(count(moved.edges, "relation"))
    return _labelled(moved=moved_rows, added=added, cleared=count(gone.nodes, "kind").unionByName(count(gone.edges, "relation")))


# --- names and times -------------------------------------------------------------------------


def qualified_names(spark, sf_dir):
    """Names with registered, known and other prefixes, without one, and full names, resolved by a table of namespaces."""
    key = F.col("p_partkey").cast("string")
    names = _read(spark, sf_dir, "part").select(F.explode(F.array(*[F.concat(F.lit(p), key) for p in ("shop:a:", "cpm:", "other:", "", "http://a.b/c#")])).alias("id"))
    spaces = spark.createDataFrame([("shop", "http://shop/"), ("default", "http://plain/")], S.NAMESPACES)
    return resolve(names, "id", spaces).select("id", F.col("id_qname.prefix").alias("prefix"), F.col("id_qname.local").alias("local"), F.col("id_qname.uri").alias("uri"))


_plain(qualified_names, f"""WITH k AS (SELECT p_partkey::VARCHAR AS k FROM part)
SELECT 'shop:a:' || k AS id, 'shop' AS prefix, 'a:' || k AS local, 'http://shop/a:' || k AS uri FROM k UNION ALL SELECT 'cpm:' || k, 'cpm', k, '{S.CPM_URI}' || k FROM k
UNION ALL SELECT 'other:' || k, 'other', k, '{S.EXAMPLE_URI}other/' || k FROM k UNION ALL SELECT k, 'default', k, 'http://plain/' || k FROM k UNION ALL SELECT 'http://a.b/c#' || k, NULL, k, 'http://a.b/c#' || k FROM k""")


def normal_datetimes(spark, sf_dir):
    """Times in several spellings; what is no time stays as it is."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = [F.concat(day, F.lit(end)) for end in ("T01:02:03Z", "T01:02:03", " 04:05:06", "", "?")]
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*forms)).alias("text")).select("o_orderkey", "text", normal_datetime(F.col("text")).alias("normal"))


_plain(normal_datetimes, """WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_orderkey, d || i AS text, CASE WHEN o IS NULL THEN d || i ELSE d || o END AS normal FROM d, (VALUES ('T01:02:03Z', 'T01:02:03'), ('T01:02:03', 'T01:02:03'), (' 04:05:06', 'T04:05:06'), ('', 'T00:00:00'), ('?', NULL)) v(i, o)""")


# --- templates -------------------------------------------------------------------------------


def document_from_template(spark, sf_dir):
    """The templates' graph with a domain document: customers and nations, with what ties them."""
    orders = order_graph(spark, sf_dir)
    domain = traverse.subgraph(orders, orders.nodes.filter("node_id LIKE 'cust:%' OR node_id LIKE 'nation:%'"))
    g = templates.document_from_template(_order_templates(spark, sf_dir), domain)
    return g.edges.filter("relation = 'delegation'").select(*_EDGE).unionByName(g.edges.filter("relation = 'usage'").select(*_EDGE))


_plain(document_from_template, """SELECT 'delegation' AS relation, 'cust:' || c_custkey AS arg1, 'nation:' || c_nationkey AS arg2 FROM customer
UNION ALL SELECT DISTINCT 'usage', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")


def template_findings(spark, sf_dir):
    """Required fields that templates lack: every order's template lacks what its priority says."""
    key, level = F.col("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    main = F.when(level == "1", F.lit('"bundleName":"B","x":1')).when(level == "2", F.concat(F.lit('"bundleName":"'), key, F.lit('","mainActivity":{"id":""}'))).otherwise(F.concat(F.lit('"bundleName":"'), key, F.lit('","mainActivity":{"id":"m"}')))
    lists = F.when(level == "3", F.lit(',"senderAgents":[{"id":"a"},{"id":""}]')).when(level == "4", F.lit(',"forwardConnectors":[{}],"currentAgents":[{"id":"c"}]')).otherwise(F.lit(""))
    rows = _read(spark, sf_dir, "orders").select(F.concat(F.lit("{"), main, lists, F.lit("}")).alias("value"))
    return templates.template_findings(template.parse_templates(rows)).select(F.col("bundleName").alias("bundle"), "problem")


_plain(template_findings, """SELECT CASE WHEN p = '1' THEN 'B' ELSE o_orderkey::VARCHAR END AS bundle, problem FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS p FROM orders)
JOIN (VALUES ('1', 'mainActivity'), ('2', 'mainActivity.id'), ('3', 'senderAgents[1].id'), ('4', 'forwardConnectors[0].id')) v(q, problem) ON p = q""")


def _people(spark, sf_dir) -> DataFrame:
    """(doc, value): a JSON-LD graph per order; its suppliers are persons and agents, its parts observations."""
    by = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey"))).alias("supps"), F.array_sort(F.collect_set(F.col("l_partkey"))).alias("parts"), F.max("l_suppkey").alias("last"))
    key, s = F.col("l_orderkey").cast("string"), lambda c: c.cast("string")
    nodes = F.concat(
        F.transform("supps", lambda x: F.concat(F.lit('{"@id":"s'), s(x), F.lit('","@type":"Person"}'))),
        F.transform("parts", lambda x: F.concat(F.lit('{"@id":"_:p'), s(x), F.lit('","@type":["sosa:Observation"]}'))),
    )
    role = F.concat(F.lit('"prov:qualifiedAssociation":[{"prov:agent":{"@id":"s'), s(F.col("last")), F.lit('"},"dcat:hadRole":"RECEIVING"},{"prov:agent":"first","dcat:hadRole":"Sender"}]'))
    also = F.concat(F.lit('"prov:wasAssociatedWith":['), F.array_join(F.transform("supps", lambda x: F.concat(F.lit('"s'), s(x), F.lit('"'))), ","), F.lit("]"))
    act = F.concat(F.lit('{"@id":"a'), key, F.lit('","@type":"prov:Activity",'), role, F.lit(","), also, F.lit("}"))
    return by.select(key.alias("doc"), F.concat(F.lit('{"@id":"b'), key, F.lit('","@graph":['), act, F.lit(","), F.array_join(nodes, ","), F.lit("]}")).alias("value"))


def jsonld_agents(spark, sf_dir):
    """Agents by role: who receives, who sends, and others associated, who send too unless named before."""
    ids = lambda c: F.array_join(F.transform(c, lambda a: a["id"]), " ")
    t = jsonld.jsonld_templates(_people(spark, sf_dir))
    return t.select(F.col("bundleName").alias("bundle"), ids("receiverAgents").alias("receivers"), ids("senderAgents").alias("senders"))


_plain(jsonld_agents, """WITH p AS (SELECT l_orderkey AS k, max(l_suppkey) AS last, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey)
SELECT 'b' || k AS bundle, 's' || last AS receivers, array_to_string(list_concat(['first'], ['s' || x FOR x IN s IF x <> last]), ' ') AS senders FROM p""")


def jsonld_first_matches(spark, sf_dir):
    """Storage bundles name the first two persons and the first five observations of a document."""
    g = jsonld.storage_bundles(_people(spark, sf_dir))
    return g.nodes.filter(F.col("ordinal") > 0).select("bundle_id", "node_id", "kind")


_plain(jsonld_first_matches, """WITH s AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM (SELECT DISTINCT l_orderkey AS k, l_suppkey AS x FROM lineitem)),
p AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS x FROM lineitem))
SELECT 'embrc:' || k || '_storage' AS bundle_id, 'embrc:s' || x AS node_id, 'agent' AS kind FROM s WHERE i <= 2 UNION ALL SELECT 'embrc:' || k || '_storage', 'embrc:obs_p' || x, 'entity' FROM p WHERE i <= 5""")


# --- rules and metrics -----------------------------------------------------------------------


@query("order", """u AS (SELECT node_id FROM n WHERE kind = 'activity' AND end_time IS NULL)
SELECT 'errors' AS what, 'ERROR' AS level, 'Region without a type' AS message, node_id AS subject FROM n WHERE node_id LIKE 'region:%'
UNION ALL SELECT 'errors', 'ERROR', 'Validation rule failed: broken', '' UNION ALL SELECT 'warnings', 'WARNING', 'Nothing shipped', node_id FROM u UNION ALL SELECT 'semantic', 'ERROR', 'Region without a type', node_id FROM n WHERE node_id LIKE 'region:%'""")
def custom_rules(g):
    """Rules of one's own, among them one that raises and one that is taken out again, read by the report's accessors."""
    def regions(x: ProvGraph) -> DataFrame:
        return x.nodes.filter("node_id LIKE 'region:%' AND size(types) = 0").select(F.lit("Region without a type").alias("message"), "node_id")

    def unshipped(x: ProvGraph) -> DataFrame:
        return x.nodes.filter("kind = 'activity' AND end_time IS NULL").select(F.lit("Nothing shipped").alias("message"), "node_id")

    def broken(x: ProvGraph) -> DataFrame:
        raise ValueError("broken")

    own = validate.Validator({})
    own.add_rule(validate.rule_of(regions))
    own.add_rule(validate.rule_of(unshipped, "WARNING", "STRUCTURE"))
    own.add_rule(broken)
    own.add_rule(validate.rule_of(regions, name="again"))
    own.remove_rule("again")
    report = own.validate(g)
    found = _labelled(errors=report.errors(), warnings=report.warnings(), semantic=report.by_type("SEMANTIC"))
    return found.select("what", "level", "message", F.coalesce("node_id", F.lit("")).alias("subject"))


@query("order", """m AS (SELECT node_id FROM n WHERE kind = 'agent'), d AS (SELECT DISTINCT src, dst FROM e WHERE relation = 'delegation'),
r AS (SELECT src AS s, dst AS t, 1 AS depth FROM d UNION SELECT s, dst, depth + 1 FROM r JOIN d ON t = src),
c AS (SELECT coalesce(min(t) FILTER (t LIKE 'region:%'), node_id) AS root FROM m LEFT JOIN r ON s = node_id GROUP BY node_id)
SELECT (SELECT count(*) FROM d) AS edge_count, round((SELECT count(*) FROM d) / ((SELECT count(*) FROM m) * ((SELECT count(*) FROM m) - 1)), 12) AS density, (SELECT max(depth) FROM r)::INTEGER AS diameter,
  (SELECT count(DISTINCT root) FROM c WHERE root IN (SELECT dst FROM d)) AS n_components, (SELECT count(DISTINCT s) FROM r) AS n_closeness""")
def metrics_bundle(g):
    """The metrics of the document of agents in one call. Every agent acts for a nation and a region in the end."""
    agents = ProvenanceDocument(traverse.subgraph(g, g.nodes.filter("kind = 'agent'"), ["actedOnBehalfOf"]))
    m = agents.compute_graph_metrics()
    n = m["connected_components"].select("component").distinct().count()
    row = (m["edge_count"], round(m["density"], 12), m["diameter"], n, m["closeness"].select("node_id").distinct().count())
    return g.spark.createDataFrame([row], "edge_count long, density double, diameter int, n_components long, n_closeness long")
