"""From templates to graphs; checks and scores of templates. Many bundles at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TemplateError
from ..functions.names import attribute_name
from ..functions.types import types_of
from ..graph import ProvGraph, empty, graph_of
from ..plans.scratch import materialize
from ..sources.build import edge_rows
from ..sources.jsonld import jsonld_templates
from ..sources.template import LISTS, parse_templates

_TYPES = {"backwardConnectors": "BackwardConnector", "forwardConnectors": "ForwardConnector", "senderAgents": "SenderAgent", "receiverAgents": "ReceiverAgent", "currentAgents": "CurrentAgent", "identifierEntities": "IdentifierEntity"}
_CONNECTOR_ATTRIBUTES = ("externalId", "referencedBundleId", "referencedMetaBundleId", "referencedBundleHashValue", "hashAlg", "provenanceServiceUri")
_ATTRIBUTES = {"backwardConnectors": _CONNECTOR_ATTRIBUTES, "forwardConnectors": _CONNECTOR_ATTRIBUTES, "senderAgents": ("contactIdPid",), "receiverAgents": ("contactIdPid",), "currentAgents": ("contactIdPid",), "identifierEntities": ("externalId", "externalIdType", "comment")}
# Names of the score levels.
LEVELS = ("Poor", "Fair", "Good", "Very Good", "Excellent", "Outstanding")


def _filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def _items(t: DataFrame, name: str) -> DataFrame:
    """(bundle_id, place, x): the elements of one list."""
    return t.select(F.col("bundleName").alias("bundle_id"), F.posexplode(name).alias("place", "x"))


def template_graph(templates: DataFrame, merge_agents: bool = True) -> ProvGraph:
    """Nodes, attributes and relations of every template, each in its bundle.

    An agent id in several lists is one agent with all these types and its first attributes;
    without ``merge_agents`` each list gives a record of its own. Relations whose target is no
    element of the template are left out.
    """
    spark = templates.sparkSession
    templates = materialize(templates, "templates")  # every list is read on its own
    main = templates.select(F.col("bundleName").alias("bundle_id"), F.col("mainActivity").alias("x"))
    null = F.lit(None).cast("timestamp")
    parts = [main.select("bundle_id", F.col("x.id").alias("node_id"), F.lit("activity").alias("kind"), types_of("cpm:MainActivity").alias("types"), F.try_to_timestamp("x.startTime").alias("start_time"), F.try_to_timestamp("x.endTime").alias("end_time"), F.lit(0).cast("long").alias("ordinal"))]
    for k, name in enumerate(LISTS, 1):
        kind = "agent" if name.endswith("Agents") else "entity"
        parts.append(_items(templates, name).select("bundle_id", F.col("x.id").alias("node_id"), F.lit(kind).alias("kind"), types_of(f"cpm:{_TYPES[name]}").alias("types"), null.alias("start_time"), null.alias("end_time"), (F.lit(k * 1_000_000) + F.col("place")).alias("ordinal")))
    records = reduce(DataFrame.unionByName, parts).filter(_filled("node_id"))
    united = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "types"))), lambda r: r["types"])))
    once = F.lit(0) if merge_agents else F.when(F.col("kind") == "agent", F.col("ordinal")).otherwise(0)
    nodes = records.groupBy("bundle_id", "node_id", "kind", once.alias("copy")).agg(united.alias("types"), F.min("start_time").alias("start_time"), F.min("end_time").alias("end_time"), F.min("ordinal").alias("ordinal"))
    nodes = nodes.select("bundle_id", "node_id", "kind", "types", "start_time", "end_time", F.lit(False).alias("is_placeholder"), "ordinal")

    attrs = _attributes(templates, main)
    edges = _relations(templates, main)
    prefixes = templates.select(F.explode("prefixes").alias("prefix", "uri"))
    base = empty(spark)
    names = prefixes.unionByName(base.namespaces).dropDuplicates(["prefix"])
    return graph_of(nodes, edges, attrs, names, templates.select(F.col("bundleName").alias("bundle_id")).distinct(), dedupe=False)


def _attributes(templates: DataFrame, main: DataFrame) -> DataFrame:
    def rows(items: DataFrame, fixed: list[tuple[str, Column]], rank: Column) -> DataFrame:
        pairs = F.array_compact(F.array(*[F.when(_filled(c), F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))) for n, c in fixed]))
        own = F.transform(F.map_entries(F.coalesce(F.col("x.attributes"), F.create_map().cast("map<string, string>"))), lambda e: F.named_struct(F.lit("name"), attribute_name(e["key"]), F.lit("value"), e["value"]))
        return items.select(F.col("x.id").alias("record_id"), rank.alias("rank"), F.posexplode(F.concat(pairs, own)).alias("ordinal", "pair")).select("record_id", "rank", F.col("ordinal").cast("long").alias("ordinal"), "pair.name", "pair.value")

    found = [rows(main, [("prov:startTime", F.col("x.startTime")), ("prov:endTime", F.col("x.endTime")), ("cpm:referencedMetaBundleId", F.col("x.referencedMetaBundleId"))], F.lit(0))]
    parts = main.select(F.col("x.id").alias("record_id"), F.lit(0).alias("rank"), F.posexplode("x.hasPart").alias("ordinal", "value"))
    found.append(parts.select("record_id", "rank", F.col("ordinal").cast("long").alias("ordinal"), F.lit("dct:hasPart").alias("name"), "value"))
    for k, name in enumerate(LISTS, 1):
        found.append(rows(_items(templates, name), [(f"cpm:{a}", F.col(f"x.{a}")) for a in _ATTRIBUTES[name]], F.lit(k)))
    everything = reduce(DataFrame.unionByName, found)
    first = everything.groupBy(F.col("record_id").alias("r")).agg(F.min("rank").alias("first"))
    kept = everything.join(first, (F.col("record_id") == F.col("r")) & (F.col("rank") == F.col("first")))
    return kept.select("record_id", F.lit("node").alias("record_class"), "name", "value", F.lit("string").alias("value_type"), "ordinal").distinct()


def _relations(templates: DataFrame, main: DataFrame) -> DataFrame:
    b = F.col("bundle_id")
    used = main.select("bundle_id", F.col("x.id").alias("a"), F.explode("x.used").alias("t"))
    made = main.select("bundle_id", F.col("x.id").alias("a"), F.explode("x.generated").alias("t"))
    both = _items(templates, "backwardConnectors").unionByName(_items(templates, "forwardConnectors"))
    each = lambda c: both.select("bundle_id", F.col("x.id").alias("a"), F.explode(f"x.{c}").alias("t"))
    owned = both.filter("x.attributedTo IS NOT NULL").select("bundle_id", F.col("x.id").alias("a"), F.col("x.attributedTo").alias("t"))
    special = _items(templates, "forwardConnectors").select("bundle_id", F.col("x.id").alias("a"), F.col("x.specializationOf").alias("t")).filter(_filled("t"))
    a, t = F.col("a"), F.col("t")
    edges = reduce(DataFrame.unionByName, [
        edge_rows(used, b, "usage", a, t["targetId"], t["relationId"]),
        edge_rows(made, b, "generation", t, a),
        edge_rows(owned, b, "attribution", a, t["targetId"], t["relationId"]),
        edge_rows(each("derivedFrom"), b, "derivation", a, t),
        edge_rows(each("specializedBy"), b, "specialization", t, a),
        edge_rows(special, b, "specialization", a, t),
    ])
    ids = lambda names: reduce(DataFrame.union, [_items(templates, n).select("bundle_id", F.col("x.id").alias("id")) for n in names])
    entities = ids(["backwardConnectors", "forwardConnectors", "identifierEntities"])
    agents = ids(["senderAgents", "receiverAgents", "currentAgents"])
    known = entities.select("bundle_id", "id", F.lit("entity").alias("as")).union(agents.select("bundle_id", "id", F.lit("agent"))).union(main.select("bundle_id", "x.id", F.lit("activity"))).distinct()
    wanted = {"usage": ("activity", "entity"), "generation": ("entity", "activity"), "attribution": ("entity", "agent"), "derivation": ("entity", "entity"), "specialization": ("entity", "entity")}
    for k, arg in enumerate(("arg1", "arg2")):
        kinds = reduce(lambda rest, r, k=k: F.when(F.col("relation") == r[0], F.lit(r[1][k])).otherwise(rest), wanted.items(), F.lit(None).cast("string"))
        end = known.select(F.col("bundle_id").alias("_b"), F.col("id").alias("_i"), F.col("as").alias("_k"))
        edges = edges.withColumn("_want", kinds).join(end, (b == F.col("_b")) & (F.col(arg) == F.col("_i")) & (F.col("_want") == F.col("_k")), "left_semi").drop("_want")
    return edges


def document_from_template(templates: DataFrame, domain: ProvGraph | None = None) -> ProvGraph:
    """The templates' graph, with a domain document united with it."""
    from .merge import union_graphs

    g = template_graph(templates)
    return g if domain is None else union_graphs(g, domain)


def template_findings(templates: DataFrame) -> DataFrame:
    """(bundleName, problem): required fields that are missing, in all six lists."""
    need = [F.when(~_filled("bundleName"), F.lit("bundleName")), F.when(F.col("mainActivity").isNull(), F.lit("mainActivity")), F.when(F.col("mainActivity").isNotNull() & ~_filled("mainActivity.id"), F.lit("mainActivity.id"))]

    def lacking(name: str) -> Column:
        at = F.transform(name, lambda x, i: F.when(~_filled(x["id"]), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].id"))))
        return F.concat_ws(";", F.filter(at, lambda p: p.isNotNull()))

    need += [lacking(name) for name in LISTS]
    problems = F.filter(F.flatten(F.array(*[F.split(F.coalesce(n, F.lit("")), ";") for n in need])), lambda p: p != "")
    return templates.select("bundleName", F.explode(problems).alias("problem"))


def check_templates(templates: DataFrame) -> DataFrame:
    """The templates, if no required field is missing; else an error that names the first problems."""
    found = template_findings(templates).limit(5).collect()
    if found:
        raise TemplateError("; ".join(f"{r.bundleName}: missing {r.problem}" for r in found))
    return templates


def agent_overlap(templates: DataFrame, merge_agents: bool = True) -> DataFrame:
    """Per template: senders, receivers, ids in both, and per such id its attributes and conflicts."""
    return templates.select("bundleName", *_agents(merge_agents))


def _agents(merge_agents: bool = True) -> list[Column]:
    ids = lambda c: F.array_distinct(F.transform(c, lambda a: a["id"]))
    both = F.array_sort(F.array_intersect(ids("senderAgents"), ids("receiverAgents")))
    keys = lambda c, i: F.coalesce(F.map_keys(F.get(F.filter(c, lambda a: a["id"] == i), F.lit(0))["attributes"]), F.array().cast("array<string>"))

    def detail(i: Column) -> Column:
        s, r = keys("senderAgents", i), keys("receiverAgents", i)
        return F.named_struct(F.lit("id"), i, F.lit("sender_attributes"), F.size(s), F.lit("receiver_attributes"), F.size(r), F.lit("total_attributes"), F.size(F.array_union(s, r)), F.lit("conflicts"), F.size(F.array_intersect(s, r)))

    return [
        F.size(ids("senderAgents")).alias("total_senders"), F.size(ids("receiverAgents")).alias("total_receivers"), F.size(both).alias("overlapping_count"), both.alias("overlapping_ids"),
        F.transform(both, detail).alias("overlap_details"), ((F.size(both) > 0) & F.lit(merge_agents)).alias("merge_recommended"),
    ]


def template_quality(templates: DataFrame) -> DataFrame:
    """Per template: ten counts, six properties, their number as a score, its level, three ratios."""
    return templates.select("bundleName", *_quality())


def _quality() -> list[Column]:
    m = F.col("mainActivity")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    connectors = F.concat("backwardConnectors", "forwardConnectors")
    counts = {
        "prefixes": size("prefixes"), "backward_connectors": size("backwardConnectors"), "forward_connectors": size("forwardConnectors"), "sender_agents": size("senderAgents"), "receiver_agents": size("receiverAgents"),
        "identifier_entities": size("identifierEntities"), "main_activity_attributes": size(m["attributes"]), "usage_relations": size(m["used"]), "generation_relations": size(m["generated"]), "has_part_relations": size(m["hasPart"]),
    }
    any_ = lambda f: F.coalesce(F.exists(connectors, f), F.lit(False))
    flags = {
        "has_timestamps": _filled(m["startTime"]) & _filled(m["endTime"]), "has_metadata": counts["prefixes"] > 3, "has_external_refs": any_(lambda c: _filled(c["referencedBundleId"])), "has_hash_validation": any_(lambda c: _filled(c["hashAlg"])),
        "has_derivations": any_(lambda c: size(c["derivedFrom"]) > 0), "has_attributions": any_(lambda c: c["attributedTo"].isNotNull()),
    }
    score = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags.values()])
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(score, F.lit(5)) + 1)
    n = counts["backward_connectors"] + counts["forward_connectors"]
    density = F.aggregate(connectors, F.lit(0), lambda s, c: s + size(c["attributes"])) / F.greatest(n, F.lit(1))
    return [
        *[c.alias(k) for k, c in counts.items()], *[F.coalesce(f, F.lit(False)).alias(k) for k, f in flags.items()], score.alias("quality_score"), level.alias("quality_level"),
        reduce(lambda a, b: a + b, counts.values()).alias("total_elements"), (n / F.greatest(counts["sender_agents"] + counts["receiver_agents"], F.lit(1))).alias("connector_ratio"), density.alias("attribute_density"),
    ]


#: How rows (doc, value) of each source format become templates.
FORMATS = {"standard": parse_templates, "mou": parse_templates, "embrc": jsonld_templates}


def transform_and_validate(texts: DataFrame, source_format: str = "standard") -> DataFrame:
    """Templates from rows (doc, value); an unknown format is read as standard, a missing field raises.

    They are written before they are checked, so that texts are parsed once.
    """
    return check_templates(materialize(FORMATS.get(source_format, parse_templates)(texts), "templates"))


def full_pipeline(texts: DataFrame, source_format: str = "standard") -> DataFrame:
    """Per template: its columns, ``quality`` and ``agents`` as structs, and the source format."""
    t = transform_and_validate(texts, source_format)
    return t.withColumns({"quality": F.struct(*_quality()), "agents": F.struct(*_agents()), "source_format": F.lit(source_format)})
