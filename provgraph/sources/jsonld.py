"""JSON-LD graphs: categories, templates, storage bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import types_of
from ..graph import ProvGraph
from .build import all_of, attr_rows, edge_rows, graph_from
from .template import templates_from

_MAP = "map<string, string>"
# Categories in the order in which they are tried, and the words that make them.
CATEGORIES = (("persons", ("person",)), ("organizations", ("organization",)), ("places", ("place",)), ("samples", ("sample",)), ("observations", ("observation",)), ("activities", ("activity", "action")))
FIRST_PERSONS, FIRST_OBSERVATIONS = 2, 5
PREFIXES = {"schema": "https://schema.org/", "cpm": "https://www.commonprovenancemodel.org/cpm-namespace-v1-0/", "sosa": "http://www.w3.org/ns/sosa/", "dct": "http://purl.org/dc/terms/", "embrc": "http://embrc.eu/ns/"}


def _list(raw: Column) -> Column:
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def _key(m: Column | str, name: str) -> Column:
    return F.try_element_at(F.col(m) if isinstance(m, str) else m, F.lit(name))


def _refs(raw: Column) -> Column:
    """Ids that a value refers to: strings, or objects with ``@id`` or ``id``; one or several."""

    def ref(x: Column) -> Column:
        m = F.from_json(x, _MAP)
        return F.when(x.startswith("{"), F.coalesce(m["@id"], m["id"])).otherwise(x)

    return F.filter(F.transform(_list(raw), ref), lambda x: x.isNotNull() & (x != ""))


def _context(raw: Column) -> Column:
    """The contexts of a list, merged into one map."""
    parts = F.transform(F.filter(_list(raw), lambda x: x.startswith("{")), lambda x: F.map_filter(F.from_json(x, _MAP), lambda k, v: ~v.startswith("{")))
    return F.aggregate(parts, F.create_map().cast(_MAP), lambda a, x: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(x, k)), x))


def nodes_of(texts: DataFrame) -> DataFrame:
    """(doc, bundle_id, context, place, types, m) per node of the ``@graph`` of rows (doc, value).

    A ``Bundle`` node with a graph of its own is opened. Lists of contexts are merged into one map.
    """
    top = texts.select("doc", F.from_json("value", _MAP).alias("d"))
    graph = top.select("doc", _key("d", "@id").alias("bundle_id"), _key("d", "@context").alias("context"), F.posexplode(_list(_key("d", "@graph"))).alias("place", "raw"))
    graph = graph.withColumn("m", F.from_json("raw", _MAP))
    inner = graph.filter(_key("m", "@graph").isNotNull()).select("doc", _key("m", "@id").alias("bundle_id"), "context", F.posexplode(_list(_key("m", "@graph"))).alias("place", "raw")).withColumn("m", F.from_json("raw", _MAP))
    both = graph.filter(_key("m", "@graph").isNull()).unionByName(inner)
    return both.select("doc", "bundle_id", _context(F.col("context")).alias("context"), "place", _list(_key("m", "@type")).alias("types"), "m")


def _opened(rows: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and ``nodes`` (place, m, types), those of ``nodes_of`` in an array, of rows with a parsed document ``d``."""
    maps = lambda raw: F.transform(_list(raw), lambda x, i: F.named_struct(F.lit("place"), i, F.lit("m"), F.from_json(x, _MAP)))
    t = rows.select(*keep, maps(_key("d", "@graph")).alias("graph"))
    has_graph = lambda n: _key(n["m"], "@graph").isNotNull()
    inner = F.flatten(F.transform(F.filter("graph", has_graph), lambda n: maps(_key(n["m"], "@graph"))))
    by_place = lambda nodes: F.array_sort(nodes, lambda x, y: x["place"] - y["place"])
    nodes = F.when(F.exists("graph", has_graph), by_place(F.concat(F.filter("graph", lambda n: ~has_graph(n)), inner))).otherwise(F.col("graph"))
    kept = [c for c in t.columns if c != "graph"]
    return t.select(*kept, F.transform(nodes, lambda n: F.named_struct(F.lit("place"), n["place"], F.lit("m"), n["m"], F.lit("types"), _list(_key(n["m"], "@type")))).alias("nodes"))


def _category(types: Column) -> Column:
    """The first category whose word is in the types, else other."""
    low = F.lower(F.concat_ws(" ", types))
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return reduce(lambda rest, c: F.when(has(c[1]), F.lit(c[0])).otherwise(rest), reversed(CATEGORIES), F.lit("other"))


def categories(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``category``: the first whose word is in the node's types, else other."""
    return nodes.withColumn("category", _category(F.col("types")))


def jsonld_templates(texts: DataFrame) -> DataFrame:
    """A template per document: its first activity, what that uses and generates, and its agents.

    A document is a row from its text to its template, so nothing is shuffled.
    """
    t = _opened(texts.withColumn("d", F.from_json("value", _MAP)), F.coalesce(_key("d", "@id"), F.lit("embrc:bundle")).alias("name"), _key("d", "@context").alias("raw_context"))
    of_type = lambda word: F.filter("nodes", lambda n: F.exists(n["types"], lambda t: t.contains(word)))

    def entity(n: Column) -> Column:
        m = n["m"]
        made_id = F.concat(F.lit("gen:"), F.substring(F.md5(F.to_json(m)), 1, 8))
        derived = F.filter(F.transform(_list(_key(m, "prov:wasDerivedFrom")), lambda x: F.when(x.startswith("{"), F.from_json(x, _MAP)["@id"]).otherwise(x)), lambda x: x.isNotNull())
        has = lambda *names: reduce(lambda a, b: a | b, [F.map_contains_key(m, k) for k in names])
        return F.named_struct(F.lit("place"), n["place"], F.lit("id"), F.coalesce(_key(m, "@id"), made_id), F.lit("derived"), derived, F.lit("used"), has("prov:wasUsedBy", "used"), F.lit("made"), has("prov:wasGeneratedBy", "generated"))

    context = F.when(F.size("nodes") > 0, _context(F.col("raw_context")))
    t = t.select("name", context.alias("context"), F.get(of_type("Activity"), F.lit(0))["m"].alias("a"), F.transform(of_type("Entity"), entity).alias("known"))
    t = t.withColumns({"back": F.filter("known", lambda e: e["used"]), "front": F.filter("known", lambda e: ~e["used"] & e["made"])})

    refs = lambda *names: F.array_distinct(F.concat(*[_refs(_key("a", n)) for n in names]))
    used, made = refs("prov:used", "used", "object"), refs("prov:generated", "generated", "result")
    derived_of = lambda i: F.get(F.filter("known", lambda e: e["id"] == i), F.lit(0))["derived"]
    entry = lambda i, d: F.named_struct(F.lit("id"), i, F.lit("derivedFrom"), F.when(F.size(d) > 0, d))
    of_refs = lambda ids: F.transform(ids, lambda i: entry(i, derived_of(i)))
    of_list = lambda c: F.transform(c, lambda e: entry(e["id"], e["derived"]))
    t = t.withColumns({"used": used, "made": made})
    neither = (F.size("used") == 0) & (F.size("made") == 0) | F.col("a").isNull()
    pairs = F.transform(F.filter(_list(_key("a", "prov:qualifiedAssociation")), lambda x: x.startswith("{")), lambda x: F.from_json(x, _MAP))
    role = lambda m: F.lower(F.coalesce(_key(m, "dcat:hadRole"), F.lit(""))).contains("receiv")
    agents = lambda keep: F.array_distinct(F.flatten(F.transform(F.filter(pairs, keep), lambda m: _refs(_key(m, "prov:agent")))))
    t = t.withColumns({"receivers": agents(role), "senders": agents(lambda m: ~role(m))})
    t = t.withColumn("senders", F.array_distinct(F.concat("senders", F.array_except(F.array_except(_refs(_key("a", "prov:wasAssociatedWith")), "receivers"), "senders"))))
    nonempty = lambda c: F.when(F.size(c) > 0, c)
    return templates_from(t.select(
        F.col("context").alias("prefixes"), F.col("name").alias("bundleName"),
        F.struct(
            F.coalesce(_key("a", "@id"), F.lit("embrc:mainActivity")).alias("id"), F.coalesce(_key("a", "prov:startedAtTime"), _key("a", "startTime")).alias("startTime"), F.coalesce(_key("a", "prov:endedAtTime"), _key("a", "endTime")).alias("endTime"),
            nonempty(F.transform("used", lambda i: F.named_struct(F.lit("targetId"), i))).alias("used"), nonempty(F.col("made")).alias("generated"),
        ).alias("mainActivity"),
        nonempty(F.when(neither, of_list(F.col("back"))).otherwise(of_refs(F.col("used")))).alias("backwardConnectors"), nonempty(F.when(neither, of_list(F.col("front"))).otherwise(of_refs(F.col("made")))).alias("forwardConnectors"),
        nonempty(F.transform("senders", lambda i: F.named_struct(F.lit("id"), i))).alias("senderAgents"), nonempty(F.transform("receivers", lambda i: F.named_struct(F.lit("id"), i))).alias("receiverAgents"),
    ))


def storage_bundles(texts: DataFrame) -> ProvGraph:
    """A storage bundle per document (``doc`` names it): main activity, two connectors, samples, the first
    two persons as senders, the first five observations.

    A text is parsed in its row; what a document's texts have of these nodes then meets in one grouping.
    """
    spark = texts.sparkSession
    d = texts.select("doc").distinct()
    bundle = F.concat(F.lit("embrc:"), F.col("doc"), F.lit("_storage"))
    own = lambda x: F.concat(F.lit("embrc:"), F.col("doc"), F.lit(f"_{x}"))
    main, back, front = own("mainActivity"), own("backwardConnector"), own("forwardConnector")
    edges = all_of(edge_rows(d, bundle, "usage", main, back), edge_rows(d, bundle, "generation", front, main), edge_rows(d, bundle, "derivation", front, back))
    person_id = lambda rid: F.concat(F.lit("embrc:"), F.replace(F.replace(rid, F.lit("https://"), F.lit("")), F.lit("/"), F.lit("_")))
    named = lambda p: lambda rid: F.concat(F.lit("embrc:"), F.replace(rid, F.lit("_:"), F.lit(p)))
    chosen = (("persons", person_id, "agent", "cpm:senderAgent"), ("samples", named("sample_"), "entity", "sosa:Sample"), ("observations", named("obs_"), "entity", "sosa:Observation"))

    fixed = [(main, "activity", "cpm:mainActivity"), (back, "entity", "cpm:backwardConnector"), (front, "entity", "cpm:forwardConnector")]
    node = lambda i, place, k: F.struct(i.alias("node_id"), place.cast("long").alias("ordinal"), F.lit(k).alias("k"))
    of = lambda n, c: F.transform(c[0], lambda x: node(c[1](x["id"]), x["place"], n))
    every = F.concat(F.array(*[node(i, F.lit(0), k) for k, (i, _, _) in enumerate(fixed)]), *[of(len(fixed) + n, c) for n, c in enumerate(chosen)])
    # an id is a record of its own in every bundle; within a bundle the first one stays
    rows = _chosen(texts).select(bundle.alias("bundle_id"), F.array_sort(every).alias("all"))
    first = lambda x, i: (i == 0) | ~x["node_id"].eqNullSafe(F.get("all", i - 1)["node_id"])
    rows = rows.select("bundle_id", F.inline(F.filter("all", first)))
    kinds = [(kind, types_of(name)) for kind, name in [f[1:] for f in fixed] + [c[2:] for c in chosen]]
    pick = lambda part: reduce(lambda rest, k: F.when(F.col("k") == k, part(kinds[k])).otherwise(rest), range(1, len(kinds)), part(kinds[0]))
    none = F.lit(None).cast("timestamp")
    rows = rows.select("bundle_id", "node_id", pick(lambda k: F.lit(k[0])).alias("kind"), pick(lambda k: k[1]).alias("types"), none.alias("start_time"), none.alias("end_time"), F.lit(False).alias("is_placeholder"), "ordinal")

    full = _chosen(texts, "name", "description")
    persons, samples = (full.select("doc", F.inline(c)) for c in ("persons", "samples"))
    attrs = all_of(
        attr_rows(d, main, schema__name=F.concat(F.col("doc"), F.lit(" Processing"))), attr_rows(persons, person_id(F.col("id")), schema__name=F.coalesce("name", F.lit("Unknown"))),
        attr_rows(samples, named("sample_")(F.col("id")), schema__name=F.coalesce("name", F.lit("Unknown Sample")), schema__description=F.coalesce("description", F.lit(""))),
    )
    return graph_from(spark, rows, edges, attrs, PREFIXES, missing=spark.createDataFrame([], "node_id string, ordinal long"))


def _chosen(texts: DataFrame, *names: str) -> DataFrame:
    """(doc, persons, samples, observations): per document the nodes of a storage bundle (place, id, and values by name)."""
    t = _opened(texts.select("doc", F.from_json("value", _MAP).alias("d")), F.col("doc"))
    t = t.select("doc", F.transform("nodes", lambda n: F.struct(_category(n["types"]).alias("category"), n["place"].alias("place"), F.coalesce(_key(n["m"], "@id"), F.lit("")).alias("id"), *[_key(n["m"], x).alias(x) for x in names])).alias("nodes"))
    limits = {"persons": FIRST_PERSONS, "samples": None, "observations": FIRST_OBSERVATIONS}
    kept = lambda c: F.transform(F.filter("nodes", lambda n: n["category"] == c), lambda n: F.struct(n["place"].alias("place"), n["id"].alias("id"), *[n[x].alias(x) for x in names]))
    cut = lambda nodes, most: nodes if most is None else F.slice(nodes, 1, most)
    t = t.select("doc", *[cut(kept(c), most).alias(c) for c, most in limits.items()])
    by = t.groupBy("doc").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in limits])
    return by.select("doc", *[cut(F.array_sort(c), most).alias(c) for c, most in limits.items()])


def bundle_counts(g: ProvGraph) -> DataFrame:
    """Per bundle: nodes with a traversal type by any spelling, other nodes, edges."""
    ti = F.exists("types", lambda t: F.lower(t["local"]).rlike("mainactivity|connector|senderagent|receiveragent|currentagent"))
    n = g.nodes.groupBy("bundle_id").agg(F.count_if(ti).alias("ti_nodes"), F.count_if(~ti).alias("ds_nodes"))
    e = g.edges.groupBy(F.col("bundle_id").alias("_b")).agg(F.count("*").alias("n_edges"))
    return n.join(e, F.col("bundle_id").eqNullSafe(F.col("_b")), "left").select("bundle_id", "ti_nodes", "ds_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """(doc, value) of JSON-LD files; ``doc`` is the file's name without its ending."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("doc"), "value")
