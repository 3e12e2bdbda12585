"""Serialised provenance: PROV-JSON, PROV-XML and N-Triples."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import qualified, resolve
from ..graph import ProvGraph, empty, graph_of
from ..plans.scratch import materialize

# Names of the two formal arguments of each relation kind.
FORMAL = {
    "usage": ("activity", "entity"), "generation": ("entity", "activity"), "attribution": ("entity", "agent"), "derivation": ("generatedEntity", "usedEntity"), "association": ("activity", "agent"),
    "communication": ("informed", "informant"), "delegation": ("delegate", "responsible"), "influence": ("influencee", "influencer"), "specialization": ("specificEntity", "generalEntity"),
    "alternate": ("alternate1", "alternate2"), "membership": ("collection", "entity"), "start": ("activity", "trigger"), "end": ("activity", "trigger"), "invalidation": ("entity", "activity"),
}
KINDS = ("entity", "agent", "activity")
#: Records of a document before they are nodes and edges. ``what`` is a node kind or a relation kind.
_RECORD = "doc string, bundle_id string, what string, id string, arg1 string, arg2 string, start_time string, end_time string, place long, attrs array<struct<name: string, value: string, value_type: string>>"


def records_graph(records: DataFrame, namespaces: DataFrame) -> ProvGraph:
    """A graph from record rows. Top-level records come before those of bundles, entities before
    agents, activities and relations; the first record of an id wins.
    """
    spark = records.sparkSession
    rank = reduce(lambda rest, k: F.when(F.col("what") == k[1], F.lit(k[0])).otherwise(rest), enumerate(KINDS), F.lit(3))
    ordinal = ((F.when(F.col("bundle_id").isNull(), 0).otherwise(1) * 4 + rank) * F.lit(1 << 40) + F.col("place")).cast("long")
    records = records.withColumn("ordinal", ordinal).withColumn("is_node", F.col("what").isin(*KINDS))
    relations = records.filter("NOT is_node")
    edge_id = F.coalesce(F.when(~F.col("id").startswith("_:"), F.col("id")), F.concat_ws("|", "what", "arg1", "arg2"))
    edges = relations.select("bundle_id", edge_id.alias("edge_id"), F.col("what").alias("relation"), "arg1", "arg2", "ordinal")

    known = namespaces.unionByName(empty(spark).namespaces).dropDuplicates(["prefix"])
    typed = F.transform(F.filter("attrs", lambda a: a["name"] == "prov:type"), lambda a: a["value"])
    whole = records.filter("is_node").select("id", F.struct("ordinal", "bundle_id", "what", "start_time", "end_time", typed.alias("names")).alias("r"))
    # of the records of an id the first stays, with the types of all that are alike in bundle and kind
    by = whole.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("all")).select("id", F.get("all", F.lit(0)).alias("r"), "all")
    alike = F.filter("all", lambda x: x["bundle_id"].eqNullSafe(F.col("r.bundle_id")) & (x["what"] == F.col("r.what")))
    by = by.select("id", "r", F.array_distinct(F.flatten(F.transform(alike, lambda x: x["names"]))).alias("names"))
    nodes = _qualified_types(by, known).select(
        F.col("r.bundle_id").alias("bundle_id"), F.col("id").alias("node_id"), F.col("r.what").alias("kind"), "types",
        F.try_to_timestamp("r.start_time").alias("start_time"), F.try_to_timestamp("r.end_time").alias("end_time"), F.lit(False).alias("is_placeholder"), F.col("r.ordinal").alias("ordinal"),
    )
    owner = F.when(F.col("is_node"), F.col("id")).otherwise(edge_id)
    attrs = records.select(owner.alias("record_id"), F.when(F.col("is_node"), F.lit("node")).otherwise(F.lit("edge")).alias("record_class"), F.posexplode("attrs").alias("k", "a"))
    attrs = attrs.select("record_id", "record_class", "a.name", "a.value", "a.value_type", F.col("k").cast("long").alias("ordinal"))
    bundles = records.select("bundle_id").filter("bundle_id IS NOT NULL").distinct()
    return graph_of(nodes, edges, attrs, known, bundles, dedupe=False)


#: So many namespaces are looked up within a row; with more, they are joined.
FEW_NAMESPACES = 1000


def _qualified_types(rows: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``rows`` (id, r, names) with ``types``: the distinct qualified names, sorted."""
    few = namespaces.limit(FEW_NAMESPACES + 1).collect()
    if len(few) <= FEW_NAMESPACES:
        pairs = [F.lit(x).cast("string") for n in few if n.prefix is not None for x in (n.prefix, n.uri)]
        uris = F.create_map(*pairs) if pairs else F.create_map().cast("map<string, string>")
        return rows.withColumn("types", F.array_sort(F.array_distinct(F.transform("names", lambda n: qualified(n, lambda p: F.try_element_at(uris, p))))))
    each = resolve(rows.select("id", F.explode("names").alias("t")), "t", namespaces).groupBy(F.col("id").alias("_i")).agg(F.array_sort(F.collect_set("t_qname")).alias("types"))
    return rows.join(each, F.col("id") == F.col("_i"), "left").withColumn("types", F.coalesce("types", F.array().cast(f"array<{S.TYPE}>")))


# --- PROV-JSON -------------------------------------------------------------------------------

_MAP = "map<string, string>"


def _list(raw: Column) -> Column:
    """JSON text of an array as its items, of anything else as one item."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def _value(raw: Column) -> Column:
    """An attribute value: plain, or the ``$`` of an object with a type."""
    return F.when(raw.startswith("{"), F.coalesce(F.from_json(raw, _MAP)["$"], raw)).otherwise(raw)


def _value_type(raw: Column) -> Column:
    return F.coalesce(F.when(raw.startswith("{"), F.from_json(raw, _MAP)["type"]), F.lit("xsd:string"))


def _content_records(parts: DataFrame) -> DataFrame:
    """(doc, bundle_id, content map of section -> JSON text) -> record rows; prefixes are records of ``namespace``."""
    verbs = {r.verb: r.name for r in S.RELATIONS.values()} | {k: k for k in KINDS} | {"prefix": "namespace"}
    section = parts.select("doc", "bundle_id", F.explode("content").alias("section", "raw")).filter(F.col("section").isin(*verbs))
    what = reduce(lambda rest, v: F.when(F.col("section") == v[0], F.lit(v[1])).otherwise(rest), verbs.items(), F.lit(None).cast("string"))
    one = section.select("doc", "bundle_id", what.alias("what"), F.posexplode(F.from_json("raw", _MAP)).alias("place", "id", "raw"))
    rows = one.select("doc", "bundle_id", "what", "id", F.col("place").cast("long").alias("place"), F.explode(F.when(F.col("what") == "namespace", F.array("raw")).otherwise(_list(F.col("raw")))).alias("raw")).withColumn("m", F.from_json("raw", _MAP))
    args = []
    for k in (0, 1):
        key = reduce(lambda rest, v, k=k: F.when(F.col("what") == v[0], F.lit(f"prov:{v[1][k]}")).otherwise(rest), FORMAL.items(), F.lit(None).cast("string"))
        args.append(F.when(key.isNotNull(), F.try_element_at("m", key)))
    names = F.filter(F.map_keys("m"), lambda n: ~n.isin("prov:startTime", "prov:endTime", *{f"prov:{a}" for v in FORMAL.values() for a in v}) | (n.isin("prov:entity", "prov:activity", "prov:agent") & F.col("what").isin(*KINDS)))
    attrs = F.flatten(F.transform(names, lambda n: F.transform(_list(F.try_element_at("m", n)), lambda v: F.named_struct(F.lit("name"), n, F.lit("value"), _value(v), F.lit("value_type"), _value_type(v)))))
    made = rows.select("doc", "bundle_id", "what", "id", F.explode_outer(F.when(F.col("what") == "namespace", F.array("raw")).otherwise(_list(args[0]))).alias("arg1"), args[1].alias("raw2"), F.try_element_at("m", F.lit("prov:startTime")).alias("start_time"), F.try_element_at("m", F.lit("prov:endTime")).alias("end_time"), "place", attrs.alias("attrs"))
    made = made.withColumn("arg2", F.explode_outer(_list(F.col("raw2"))))
    plain = lambda c: F.coalesce(F.when(F.col(c).startswith("{"), F.from_json(c, _MAP)["$"]), F.col(c))
    return made.select("doc", "bundle_id", "what", "id", plain("arg1").alias("arg1"), plain("arg2").alias("arg2"), "start_time", "end_time", "place", "attrs")


def prov_json_graph(texts: DataFrame) -> ProvGraph:
    """From rows (doc, value) with a PROV-JSON document each. All documents form one graph.

    A document is parsed once; its records are written for the tables that are made of them.
    """
    top = texts.select("doc", F.from_json("value", _MAP).alias("m"))
    inner = top.select("doc", F.explode(F.from_json(F.try_element_at("m", F.lit("bundle")), _MAP)).alias("bundle_id", "raw")).select("doc", "bundle_id", F.from_json("raw", _MAP).alias("content"))
    records = _content_records(top.select("doc", F.lit(None).cast("string").alias("bundle_id"), F.col("m").alias("content")).unionByName(inner))
    records = materialize(records, "json-records")
    prefixes = records.filter("what = 'namespace'").select(F.col("id").alias("prefix"), F.col("arg1").alias("uri")).dropDuplicates(["prefix"])
    return records_graph(records.filter("what <> 'namespace'"), prefixes)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, value): whole files below a path or glob."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")


def texts_of(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(f"doc{k}", t) for k, t in enumerate(texts)], "doc string, value string")


# --- PROV-XML --------------------------------------------------------------------------------

_PROV = f"{{{S.PROV_URI}}}"


def _xml_records(doc: str, text: str) -> Iterator[tuple]:
    verbs = {r.verb: r.name for r in S.RELATIONS.values()} | {k: k for k in KINDS}
    prefixes = dict(kv for _, kv in ET.iterparse(io.BytesIO(text.encode()), events=["start-ns"]))
    by_uri = {u: p for p, u in prefixes.items()}

    def name(tag: str) -> str:
        uri, _, local = tag[1:].partition("}") if tag[0] == "{" else ("", "", tag)
        return f"{by_uri[uri]}:{local}" if by_uri.get(uri) else local

    def walk(parent: ET.Element, bundle: str | None) -> Iterator[tuple]:
        for place, e in enumerate(parent):
            local = e.tag.removeprefix(_PROV)
            if local == "bundleContent":
                yield from walk(e, e.get(f"{_PROV}id"))
            elif local in verbs:
                what, formal = verbs[local], FORMAL.get(verbs[local], ())
                args, attrs, times = {}, [], {}
                for c in e:
                    key = c.tag.removeprefix(_PROV)
                    if key in formal and c.get(f"{_PROV}ref"):
                        args[key] = c.get(f"{_PROV}ref")
                    elif key in ("startTime", "endTime"):
                        times[key] = (c.text or "").strip()
                    else:
                        attrs.append({"name": name(c.tag), "value": (c.text or "").strip(), "value_type": c.get("{http://www.w3.org/2001/XMLSchema-instance}type", "xsd:string")})
                ends = [args.get(a) for a in formal] or [None, None]
                yield doc, bundle, what, e.get(f"{_PROV}id"), *ends, times.get("startTime"), times.get("endTime"), place, attrs

    yield from walk(ET.fromstring(text), None)
    yield from ((doc, None, "namespace", p, u, None, None, None, 0, []) for p, u in prefixes.items() if p)


def prov_xml_graph(texts: DataFrame) -> ProvGraph:
    """From rows (doc, value) with a PROV-XML document each; one document is parsed in one task."""
    attr = pa.struct([(c, pa.string()) for c in ("name", "value", "value_type")])
    schema = pa.schema([(c, pa.string()) for c in ("doc", "bundle_id", "what", "id", "arg1", "arg2", "start_time", "end_time")] + [("place", pa.int64()), ("attrs", pa.list_(attr))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records = _xml_records(doc, value)
                while part := list(islice(records, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    rows = materialize(texts.select("doc", "value").mapInArrow(run, _RECORD), "xml-records")
    prefixes = rows.filter("what = 'namespace'").select(F.col("id").alias("prefix"), F.col("arg1").alias("uri")).dropDuplicates(["prefix"])
    return records_graph(rows.filter("what <> 'namespace'"), prefixes)


# --- N-Triples -------------------------------------------------------------------------------

_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _unescaped(body: Column) -> Column:
    """The text of an N-Triples literal; every escape is read once, from left to right."""
    plain = F.create_map(*[F.lit(x) for pair in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")) for x in pair])
    wide = lambda t, charset: F.decode(F.unhex(F.substr(t, F.lit(3))), charset)
    char = lambda t: F.when(t.startswith("\\U"), wide(t, "UTF-32")).when(t.startswith("\\u"), wide(t, "UTF-16BE")).when(t.startswith("\\"), F.coalesce(F.try_element_at(plain, t), F.substr(t, F.lit(2)))).otherwise(t)
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+)"), F.lit(1))
    return F.when(body.contains("\\"), F.array_join(F.transform(parts, char), "")).otherwise(body)


def ntriples_graph(lines: DataFrame) -> ProvGraph:
    """From a column ``value`` of N-Triples lines: kinds, types, the plain PROV relations, other attributes.

    Ids are full URIs. Attributes keep the datatype of their literal, with the usual prefixes. A line is parsed once;
    its parts are written for the tables that are made of them.
    """
    t = lines.select(F.regexp_extract("value", r"^<([^>]*)>", 1).alias("s"), F.regexp_extract("value", r"^<[^>]*>\s+<([^>]*)>", 1).alias("p"), F.regexp_extract("value", r"^<[^>]*>\s+<[^>]*>\s+(.*?)\s*\.\s*$", 1).alias("o")).filter("s <> ''")
    obj = F.when(F.col("o").startswith("<"), F.regexp_extract("o", r"^<([^>]*)>", 1)).otherwise(_unescaped(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)))
    datatype = F.replace(F.nullif(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1), F.lit("")), F.lit(S.XSD_URI), F.lit("xsd:"))
    t = t.select("s", "p", obj.alias("o"), F.col("o").startswith("<").alias("is_ref"), F.coalesce(datatype, F.lit("xsd:string")).alias("datatype"))
    kinds = {f"{S.PROV_URI}{k.capitalize()}": k for k in KINDS}
    verbs = {f"{S.PROV_URI}{r.verb}": r.name for r in S.RELATIONS.values()}
    pick = lambda c, d: reduce(lambda rest, kv: F.when(F.col(c) == kv[0], F.lit(kv[1])).otherwise(rest), d.items(), F.lit(None).cast("string"))
    t = materialize(t.select("*", pick("p", verbs).alias("relation")), "ntriples")
    related = t.filter("relation IS NOT NULL AND is_ref")
    none, start, end = F.lit(None).cast("string"), f"{S.PROV_URI}startedAtTime", f"{S.PROV_URI}endedAtTime"
    if_p = lambda p: F.when(F.col("p") == p, F.col("o"))
    said = t.filter(F.col("p").isin(_TYPE, start, end)).withColumn("kind", F.when(F.col("p") == _TYPE, pick("o", kinds)))
    said = said.select("s", "kind", F.when(F.col("kind").isNull(), if_p(_TYPE)).alias("uri"), if_p(start).alias("a"), if_p(end).alias("b"), F.lit(False).alias("is_end"))
    # what is said of a node and the ends of relations meet by id: an id without a kind that is such an end is a placeholder
    ends = related.select(F.explode(F.array("s", "o")).alias("s"), none.alias("kind"), none.alias("uri"), none.alias("a"), none.alias("b"), F.lit(True).alias("is_end"))
    by = said.unionByName(ends).groupBy("s").agg(F.max("kind").alias("kind"), F.max("a").alias("a"), F.max("b").alias("b"), F.bool_or("is_end").alias("is_end"), F.array_sort(F.collect_set("uri")).alias("uris"))
    as_type = lambda u: F.named_struct(F.lit("prefix"), none, F.lit("local"), F.element_at(F.split(u, "[/#]"), -1), F.lit("uri"), u)
    known = lambda c: F.when(F.col("kind").isNotNull(), c)
    nodes = by.filter("kind IS NOT NULL OR is_end").select(
        none.alias("bundle_id"), F.col("s").alias("node_id"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce(known(F.transform("uris", as_type)), F.array().cast(f"array<{S.TYPE}>")).alias("types"),
        known(F.try_to_timestamp("a")).alias("start_time"), known(F.try_to_timestamp("b")).alias("end_time"), F.col("kind").isNull().alias("is_placeholder"), F.lit(0).cast("long").alias("ordinal"),
    )
    edges = related.select("s", "relation", "o").distinct().select(none.alias("bundle_id"), F.concat_ws("|", "relation", "s", "o").alias("edge_id"), "relation", F.col("s").alias("arg1"), F.col("o").alias("arg2"), F.lit(0).cast("long").alias("ordinal"))
    attrs = t.filter(F.col("relation").isNull() & (F.col("p") != _TYPE)).select(F.col("s").alias("record_id"), F.lit("node").alias("record_class"), F.col("p").alias("name"), F.col("o").alias("value"), F.when(F.col("is_ref"), F.lit("xsd:anyURI")).otherwise(F.col("datatype")).alias("value_type"), F.lit(0).cast("long").alias("ordinal"))
    return graph_of(nodes, edges, attrs, dedupe=False, missing=lines.sparkSession.createDataFrame([], "node_id string, ordinal long"))


def import_document(spark: SparkSession, text: str, format_name: str = "json") -> ProvGraph:
    """A graph from one serialised document: ``json``, ``xml`` or ``rdf`` (N-Triples)."""
    if format_name == "json":
        return prov_json_graph(texts_of(spark, text))
    if format_name == "xml":
        return prov_xml_graph(texts_of(spark, text))
    if format_name in ("rdf", "nt"):
        return ntriples_graph(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"))
    raise ValueError(f"unknown format {format_name!r}")
