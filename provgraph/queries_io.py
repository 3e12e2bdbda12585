"""Registered queries over sources and sinks: what is written in a format is read back, and SQL says what must come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ProvGraph
from .operators import merge, metrics, templates
from .plans.scratch import materialize, scratch_path
from .queries import _order_templates, _plain, query
from .sinks import export
from .sources import formats, jsonld, records, template
from .sources.build import all_of, attr_rows, edge_rows, graph_from, id_of, node_rows
from .sources.relational import _none_missing, activity_graph


def _read(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- provenance formats ----------------------------------------------------------------------


#: A text with line breaks, quotes, markup, backslashes and letters beyond ASCII, in SQL; _awkward() is the same in Spark.
_AWKWARD = "'say \"' || o_orderpriority || '\"' || chr(10) || '<b>&amp; \\n' || o_orderkey || '\\ é\U0001f600' || chr(9) || 'end'"


def _awkward() -> Column:
    return F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"\n<b>&amp; \\n'), F.col("o_orderkey").cast("string"), F.lit("\\ é\U0001f600\tend"))


def _bundles(spark, sf_dir) -> ProvGraph:
    """A bundle per order: its activity with times and an awkward note, and the items that it makes."""
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    order, item, of = id_of("ex:order", "o_orderkey"), id_of("ex:item", "l_orderkey", "l_linenumber"), id_of("ex:order", "l_orderkey")
    name = lambda c: F.regexp_replace(c, ":(\\d)", "-$1")  # noqa: E731  one colon, after the prefix
    bundle = lambda key: F.concat(F.lit("ex:b"), F.col(key).cast("string"))
    known = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    nodes = all_of(node_rows(orders, bundle("o_orderkey"), name(order), "activity", "cpm:MainActivity", start=F.col("o_orderdate")), node_rows(known, bundle("l_orderkey"), name(item), "entity"))
    edges = edge_rows(known, bundle("l_orderkey"), "generation", name(item), name(of))
    return graph_from(spark, nodes, edges, attr_rows(orders, name(order), ex__note=_awkward()), {"ex": "http://example.org/ex/"}, missing=_none_missing(spark))


def _content(g: ProvGraph, local: bool = False) -> DataFrame:
    """Nodes with kind, type, start and note, and edges, as rows of text. ``local``: ids by what follows the last slash."""
    short = (lambda c: F.concat(F.lit("ex:"), F.element_at(F.split(c, "/"), -1))) if local else F.col
    note = g.attrs.filter("record_class = 'node' AND (name LIKE '%note')").select(F.col("record_id").alias("_r"), "value")
    n = g.nodes.join(note, F.col("node_id") == F.col("_r"), "left").select(
        F.lit("node").alias("record"), short("node_id").alias("id"), F.concat_ws(" ", "kind", F.get("types", F.lit(0))["local"], F.date_format("start_time", "yyyy-MM-dd"), F.md5("value")).alias("what")
    )
    return n.unionByName(g.edges.select(F.lit("edge").alias("record"), short("arg1").alias("id"), F.concat_ws(" ", "relation", short("arg2")).alias("what")))


_CONTENT = f"""
SELECT 'node' AS record, 'ex:order-' || o_orderkey AS id, 'activity MainActivity ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || md5({_AWKWARD}) AS what FROM orders
UNION ALL SELECT 'node', 'ex:item-' || k || '-' || i, 'entity' FROM l UNION ALL SELECT 'edge', 'ex:item-' || k || '-' || i, 'generation ex:order-' || k FROM l"""
_ITEMS = "WITH l AS (SELECT DISTINCT l_orderkey AS k, replace(l_linenumber::VARCHAR, ':', '-') AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"


def _documents(rows: DataFrame, wrap: str) -> DataFrame:
    """(doc, value): a document per bundle from (bundle_id, part); a bundle's records make one text."""
    by = rows.groupBy(F.col("bundle_id").alias("doc")).agg(F.array_join(F.collect_list("part"), "" if wrap.startswith("<") else ",").alias("body"))
    before, after = wrap.split("BODY")
    cut = before.split("DOC")
    return by.select("doc", F.concat(F.lit(cut[0]), F.col("doc") if len(cut) > 1 else F.lit(""), F.lit(cut[-1]) if len(cut) > 1 else F.lit(""), F.col("body"), F.lit(after)).alias("value"))


def json_round_trip(spark, sf_dir):
    """PROV-JSON, a document per bundle."""
    one = export.json_records(_bundles(spark, sf_dir)).repartition("bundle_id")  # both groupings below are within it
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))  # noqa: E731  ids and sections need no escapes here
    section = one.groupBy("bundle_id", "section").agg(F.array_join(F.collect_list(F.concat(quoted("id"), F.lit(":"), F.col("record"))), ",").alias("body"))
    docs = _documents(section.select("bundle_id", F.concat(quoted("section"), F.lit(":{"), "body", F.lit("}")).alias("part")), '{"prefix":{"ex":"http://example.org/ex/"},"bundle":{"DOC":{BODY}}}')
    return _content(formats.prov_json_graph(materialize(docs, "json-documents")))


_plain(json_round_trip, _ITEMS + _CONTENT)


def xml_round_trip(spark, sf_dir):
    """PROV-XML, a document per bundle."""
    rows = export.xml_records(_bundles(spark, sf_dir)).select("bundle_id", F.col("record").alias("part"))
    spaces = 'xmlns:prov="http://www.w3.org/ns/prov#" xmlns:ex="http://example.org/ex/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    return _content(formats.prov_xml_graph(_documents(rows, f'<prov:document {spaces}><prov:bundleContent prov:id="DOC">BODY</prov:bundleContent></prov:document>')))


_plain(xml_round_trip, _ITEMS + _CONTENT)


def ntriples_round_trip(spark, sf_dir):
    """N-Triples; ids come back as full names."""
    lines = materialize(export.ntriples(_bundles(spark, sf_dir)), "ntriples-lines")
    return _content(formats.ntriples_graph(lines), local=True)


_plain(ntriples_round_trip, _ITEMS + _CONTENT)


def parquet_round_trip(spark, sf_dir):
    """The tables as Parquet, edges in a folder per relation."""
    path = scratch_path(spark, "graph")
    g = activity_graph(spark, sf_dir)
    export.write_graph(g, path)
    return spark.read.parquet(f"{path}/edges").select("relation", "arg1", "arg2")


_plain(parquet_round_trip, """
SELECT 'communication' AS relation, 'ev:' || event_id AS arg1, 'ev:' || last AS arg2 FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NOT NULL
UNION ALL SELECT 'derivation', 'turn:' || conv_id || ':' || turn, 'turn:' || conv_id || ':' || last FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations) WHERE last IS NOT NULL
UNION ALL SELECT 'attribution', 'turn:' || conv_id || ':' || turn, 'role:' || role FROM conversations
UNION ALL SELECT 'alternate', 'doc:' || doc_id, 'doc:' || first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first""")


def dot_export(spark, sf_dir):
    """Drawing statements: a box per event, an arrow per step."""
    return export.dot_lines(activity_graph(spark, sf_dir)).filter("value LIKE '\"ev:%'")


_plain(dot_export, """SELECT '"ev:' || event_id || '" [shape=box];' AS value FROM events
UNION ALL SELECT '"ev:' || last || '" -> "ev:' || event_id || '" [label="communication"];' FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NOT NULL""")


# --- templates -------------------------------------------------------------------------------


def template_files(spark, sf_dir):
    """Templates written as JSON, checked, and read again; relations as plain ids and under other keys."""
    path = scratch_path(spark, "templates")
    export.write_templates(_order_templates(spark, sf_dir), path, check=True)
    t = template.parse_templates(spark.read.text(path).select(F.regexp_replace("value", '"targetId":', '"bcId":').alias("value")))
    ids = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["id"])), " ")
    used = F.array_join(F.array_sort(F.transform(F.coalesce("mainActivity.used", F.array().cast("array<struct<targetId: string, relationId: string>>")), lambda u: u["targetId"])), " ")
    return t.select(F.col("bundleName").alias("bundle"), F.col("mainActivity.id").alias("main"), F.md5(used).alias("used_md5"), F.md5(ids("backwardConnectors")).alias("back_md5"), F.size("forwardConnectors").alias("n_forward"), F.md5(ids("senderAgents")).alias("senders_md5"))


_plain(template_files, """SELECT 'bundle:' || o_orderkey AS bundle, 'order:' || o_orderkey AS main, md5(coalesce(string_agg(DISTINCT 'part:' || l_partkey, ' ' ORDER BY 'part:' || l_partkey), '')) AS used_md5,
  md5(coalesce(string_agg(DISTINCT 'part:' || l_partkey, ' ' ORDER BY 'part:' || l_partkey), '')) AS back_md5, count(DISTINCT l_linenumber)::INTEGER AS n_forward, md5(coalesce(string_agg(DISTINCT 'supp:' || l_suppkey, ' ' ORDER BY 'supp:' || l_suppkey), '')) AS senders_md5
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")


def template_edges(spark, sf_dir):
    """Every relation of the graph that the templates make, not their counts."""
    g = templates.template_graph(_order_templates(spark, sf_dir))
    return g.edges.groupBy("bundle_id", "relation").agg(F.count("*").alias("n_edges"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "arg1", "arg2"))), "|")).alias("ends_md5"))


_plain(template_edges, """
WITH l AS (SELECT DISTINCT o_orderkey AS k, 'part:' || l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), i AS (SELECT DISTINCT o_orderkey AS k, 'item:' || o_orderkey || ':' || l_linenumber AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
x AS (SELECT k, 'usage' AS relation, 'order:' || k || ' ' || p AS ends FROM l UNION ALL SELECT k, 'generation', i || ' order:' || k FROM i UNION ALL SELECT k, 'derivation', i || ' ' || p FROM i JOIN l USING (k))
SELECT 'bundle:' || k AS bundle_id, relation, count(*) AS n_edges, md5(string_agg(ends, '|' ORDER BY ends)) AS ends_md5 FROM x GROUP BY k, relation""")


def _jsonld(spark, sf_dir) -> DataFrame:
    """(doc, value): a JSON-LD graph per order; its customer receives, its parts are used, its items come of them."""
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    ref = lambda c: F.transform(F.array_sort(c), lambda x: F.create_map(F.lit("@id"), x))
    named = lambda p, c: F.transform(F.collect_set(c), lambda k: F.concat(F.lit(p), k.cast("string")))
    by = lines.groupBy("l_orderkey").agg(named("x:part", "l_partkey").alias("parts"), named("x:item", "l_linenumber").alias("items"))
    t = orders.join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("parts", "items")})
    key, some = F.col("o_orderkey").cast("string"), lambda c: F.when(F.size(c) > 0, ref(F.col(c)))
    put = lambda **k: F.to_json(F.struct(*[v.alias(n.replace("__", ":").replace("at_", "@")) for n, v in k.items()]))
    role = F.array(F.struct(F.struct(F.concat(F.lit("x:cust"), F.col("o_custkey").cast("string")).alias("@id")).alias("prov:agent"), F.lit("Receiving agent").alias("dcat:hadRole")))
    act = put(at_id=F.concat(F.lit("x:order"), key), at_type=F.array(F.lit("prov:Activity")), startTime=F.date_format("o_orderdate", "yyyy-MM-dd"), prov__used=some("parts"), prov__generated=some("items"), prov__qualifiedAssociation=role)
    made = F.transform("items", lambda i: F.to_json(F.struct(i.alias("@id"), F.lit("prov:Entity").alias("@type"), ref(F.col("parts")).alias("prov:wasDerivedFrom"))))
    person = F.lit('{"@id":"x:clerk","@type":"Person"}')
    graph = F.array_join(F.concat(F.array(person, act), made), ",")
    return t.select(key.alias("doc"), F.concat(F.lit('{"@context":[{"prov":"http://www.w3.org/ns/prov#"}],"@id":"x:bundle'), key, F.lit('","@graph":['), graph, F.lit("]}")).alias("value"))


def jsonld_templates(spark, sf_dir):
    """Templates from JSON-LD, with their quality and agents, through the whole pipeline."""
    t = templates.full_pipeline(_jsonld(spark, sf_dir), "embrc")
    front = F.array_join(F.array_sort(F.transform("forwardConnectors", lambda c: F.concat_ws(",", c["id"], F.size(c["derivedFrom"]).cast("string")))), " ")
    return t.select(F.col("bundleName").alias("bundle"), F.col("mainActivity.id").alias("main"), F.col("mainActivity.startTime").alias("start"), F.size("backwardConnectors").alias("n_backward"), front.alias("forward"), F.get("receiverAgents", F.lit(0))["id"].alias("receiver"), F.col("quality.quality_level").alias("quality_level"), F.col("agents.total_receivers").alias("total_receivers"))


_plain(jsonld_templates, """
WITH p AS (SELECT o_orderkey AS k, any_value(o_custkey) AS c, any_value(o_orderdate) AS d, count(DISTINCT l_partkey)::INTEGER AS parts, list_sort(list(DISTINCT 'x:item' || l_linenumber) FILTER (l_linenumber IS NOT NULL)) AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT 'x:bundle' || k AS bundle, 'x:order' || k AS main, strftime(d, '%Y-%m-%d') AS start, parts AS n_backward, coalesce(array_to_string([i || ',' || parts FOR i IN items], ' '), '') AS forward, 'x:cust' || c AS receiver,
  CASE WHEN parts > 0 THEN 'Fair' ELSE 'Poor' END AS quality_level, 1 AS total_receivers FROM p""")


def jsonld_categories(spark, sf_dir):
    rows = jsonld.categories(jsonld.nodes_of(_jsonld(spark, sf_dir)))
    return rows.groupBy("category").agg(F.count("*").alias("n_nodes"))


_plain(jsonld_categories, """SELECT 'persons' AS category, count(*) AS n_nodes FROM orders UNION ALL SELECT 'activities', count(*) FROM orders
UNION ALL SELECT 'other', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))""")


def jsonld_bundles(spark, sf_dir):
    """Storage bundles of JSON-LD graphs: three nodes and a person, three edges."""
    c = jsonld.bundle_counts(jsonld.storage_bundles(_jsonld(spark, sf_dir)))
    return c.groupBy("ti_nodes", "ds_nodes", "n_edges").agg(F.count("*").alias("n_bundles"))


# --- records ---------------------------------------------------------------------------------


def simple_graph(spark, sf_dir):
    """Parts as entities; every order turns its first part into its last."""
    parts = _read(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    name = lambda c: F.concat(F.lit("p:"), c.cast("string"))
    triples = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(name(F.min("l_partkey")).alias("source"), name(F.max("l_partkey")).alias("target")).select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("activity"), "source", "target")
    return records.simple_graph(spark, parts, triples).edges.select("relation", "arg1", "arg2")


_plain(simple_graph, """WITH t AS (SELECT 'o:' || l_orderkey AS o, min(l_partkey) AS s, max(l_partkey) AS t FROM lineitem GROUP BY l_orderkey)
SELECT 'usage' AS relation, o AS arg1, 'p:' || s AS arg2 FROM t WHERE s IN (SELECT p_partkey FROM part) AND t IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'generation', 'p:' || t, o FROM t WHERE s IN (SELECT p_partkey FROM part) AND t IN (SELECT p_partkey FROM part)""")


def _patients(spark, sf_dir) -> DataFrame:
    """Patient files: customers are patients, their orders tissue samples."""
    orders = _read(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    tissue = F.concat(F.lit('<tissue number="'), s("o_orderkey"), F.lit('" sampleId="B:'), s("o_orderkey"), F.lit('" year="'), F.year("o_orderdate").cast("string"), F.lit('"><samplesNo>3</samplesNo><materialType>'), F.col("o_orderstatus"), F.lit("</materialType><cutTime>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</cutTime></tissue>"))
    by = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(tissue), "").alias("body"))  # a patient's file is one text
    value = F.concat(F.lit('<patient xmlns="http://www.bbmri.cz/schemas/biobank/data" biobank="MOU" consent="true" id="'), s("o_custkey"), F.lit('" month="--01" sex="female" year="1999"><LTS>'), F.col("body"), F.lit("</LTS></patient>"))
    path = scratch_path(spark, "patients")
    # files of at most 200 patients, each with a root element of its own
    file = F.floor(F.col("o_custkey") / 200).alias("file")
    files = by.select(file, value.alias("value")).groupBy("file").agg(F.concat(F.lit("<patients>"), F.array_join(F.collect_list("value"), ""), F.lit("</patients>")).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    return records.read_patient_samples(spark, path)


def patient_files(spark, sf_dir):
    return _patients(spark, sf_dir).select("patient_id", "sample_id", "consent", "birth_year", "year", "samples_no", "available_samples_no", "material_type", F.date_format("cut_time", "yyyy-MM-dd").alias("cut_day"))


_plain(patient_files, """SELECT o_custkey::VARCHAR AS patient_id, 'B:' || o_orderkey AS sample_id, true AS consent, 1999 AS birth_year, year(o_orderdate)::VARCHAR AS year, 3 AS samples_no, 0 AS available_samples_no, o_orderstatus AS material_type, strftime(o_orderdate, '%Y-%m-%d') AS cut_day FROM orders""")


def patient_bundles(spark, sf_dir):
    """Acquisition and storage bundles of every sample."""
    s = materialize(_patients(spark, sf_dir), "patient-samples")
    both = [records.acquisition_graph(s), records.storage_graph(s)]
    count = lambda g: g.edges.groupBy("bundle_id").agg(F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))
    return count(both[0]).unionByName(count(both[1]))


_plain(patient_bundles, """SELECT 'bbmri:acquisitionBundle-' || o_custkey || '-B-' || o_orderkey AS bundle_id, 5 AS n_edges, 'attribution,generation,specialization' AS relations FROM orders
UNION ALL SELECT 'bbmri:storageBundle-' || o_custkey || '-B-' || o_orderkey, 11, 'attribution,derivation,generation,specialization,usage' FROM orders""".replace("5 AS", "5::BIGINT AS"))


def biobank_tables(spark, sf_dir):
    """Customers as patients, orders as samples, lines as storage: what a storage bundle is derived from."""
    text = lambda c: F.col(c).cast("string")
    patients = _read(spark, sf_dir, "customer").select(text("c_custkey").alias("patient_id"), F.lit("female").alias("sex"), F.lit(1990).alias("birth_year"), F.lit(True).alias("gave_consent"))
    samples = _read(spark, sf_dir, "orders").select(text("o_orderkey").alias("sample_id"), text("o_custkey").alias("patient_id"), F.lit("S").alias("material_type"), F.lit("LTS").alias("storage_type"), F.lit("C1").alias("diagnosis"), F.col("o_orderdate").cast("timestamp").alias("taking_date"), F.lit("UNI").alias("hospital_id"))
    storage = _read(spark, sf_dir, "lineitem").select(text("l_linenumber").alias("storage_id"), text("l_orderkey").alias("sample_id"), F.lit("here").alias("storage_location"), F.col("l_shipdate").cast("timestamp").alias("stored_at"), F.lit("op").alias("operator_id"))
    g = records.biobank_graph(patients, samples, storage)
    return g.nodes.filter("node_id LIKE 'bbmri:storageAct-%'").select("bundle_id", "node_id", F.date_format("start_time", "yyyy-MM-dd").alias("stored"))


_plain(biobank_tables, """SELECT 'bbmri:storageBundle-' || o_custkey || '-' || o_orderkey AS bundle_id, 'bbmri:storageAct-' || o_custkey || '-' || o_orderkey AS node_id, strftime(min(l_shipdate), '%Y-%m-%d') AS stored
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")


_plain(jsonld_bundles, "SELECT 4 AS ti_nodes, 0 AS ds_nodes, 3 AS n_edges, count(*) AS n_bundles FROM orders".replace("4 AS", "4::BIGINT AS").replace("0 AS", "0::BIGINT AS").replace("3 AS", "3::BIGINT AS"))


@query("activity", """g AS (SELECT cause, effect, count(*) AS n_relations FROM e GROUP BY cause, effect)
SELECT 'divided' AS mode, 1::BIGINT AS n_relations, count(*) AS n_edges FROM e UNION ALL SELECT 'merged', n_relations, count(*) FROM g GROUP BY n_relations""")
def edge_groupings(g):
    """Divided and merged edges of the same graph, and how many relations each has."""
    rows = [merge.grouped_edges(g, mode).select(F.lit(mode).alias("mode"), "n_relations") for mode in ("divided", "merged")]
    return all_of(*rows).groupBy("mode", "n_relations").agg(F.count("*").alias("n_edges"))


@query("activity", "z AS (SELECT 1) SELECT (SELECT count(*) FROM a) AS edge_count, round((SELECT count(*) FROM a) / (count(*) * (count(*) - 1)), 12) AS density FROM n")
def adjacency_density(g):
    return metrics.adjacency_metrics(g).withColumn("density", F.round("density", 12))
