"""Graphs as text: PROV-N, PROV-JSON, PROV-XML, N-Triples, DOT; templates as JSON.

Each writer makes rows of text from the tables, one per record, so that a large graph is written
by many tasks; ``export`` joins them on the driver for small ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import ProvGraph
from ..schema import EXAMPLE_URI, KNOWN_PREFIXES, PROV_URI, RELATIONS
from ..sources.formats import FORMAL

_NO_ATTRS = "array<struct<name: string, value: string, value_type: string>>"


def _pick(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda rest, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(rest), table.items(), F.lit(None).cast("string"))


def _attrs(g: ProvGraph, record_class: str) -> DataFrame:
    own = g.attrs.filter(F.col("record_class") == record_class)
    return own.groupBy(F.col("record_id").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "ordinal", "value", "value_type"))), lambda a: F.named_struct(F.lit("name"), a["name"], F.lit("value"), a["value"], F.lit("value_type"), a["value_type"])).alias("attrs"))


def _full_nodes(g: ProvGraph) -> DataFrame:
    n = g.nodes.filter("NOT is_placeholder")
    return n.join(_attrs(g, "node"), F.col("node_id") == F.col("_r"), "left").withColumn("attrs", F.filter(F.coalesce("attrs", F.array().cast(_NO_ATTRS)), lambda a: ~a["name"].isin("prov:type", "prov:startTime", "prov:endTime")))


def _full_edges(g: ProvGraph) -> DataFrame:
    e = g.edges.join(_attrs(g, "edge"), F.col("edge_id") == F.col("_r"), "left")
    return e.withColumn("attrs", F.coalesce("attrs", F.array().cast(_NO_ATTRS)))


def _type_name(t: Column) -> Column:
    return F.when(t["prefix"].isNull(), t["uri"]).otherwise(F.concat_ws(":", t["prefix"], t["local"]))


def _quote(v: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def provn_lines(g: ProvGraph) -> DataFrame:
    """(bundle_id, section, record): a PROV-N statement per node and edge."""
    types = F.transform("types", lambda t: F.concat(F.lit("prov:type='"), _type_name(t), F.lit("'")))
    own = F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), _quote(F.coalesce(a["value"], F.lit("")))))
    pairs = F.array_join(F.concat(types, own), ", ")
    tail = F.when(pairs != "", F.concat(F.lit(", ["), pairs, F.lit("]"))).otherwise(F.lit(""))
    times = F.when((F.col("kind") == "activity") & (F.col("start_time").isNotNull() | F.col("end_time").isNotNull() | (tail != "")), F.concat(F.lit(", "), F.coalesce(_time("start_time"), F.lit("-")), F.lit(", "), F.coalesce(_time("end_time"), F.lit("-")))).otherwise(F.lit(""))
    nodes = _full_nodes(g).select("bundle_id", F.lit(0).alias("section"), F.concat(F.col("kind"), F.lit("("), F.col("node_id"), times, tail, F.lit(")")).alias("record"))
    verb = _pick(F.col("relation"), {r.name: r.verb for r in RELATIONS.values()})
    named = F.when(F.col("edge_id").contains("|") | F.col("edge_id").startswith("relation_"), F.lit("")).otherwise(F.concat(F.col("edge_id"), F.lit("; ")))
    more = F.when(F.col("relation").isin("usage", "generation", "start", "end", "invalidation"), F.lit(", -")).otherwise(F.lit(""))
    e_pairs = F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), _quote(F.coalesce(a["value"], F.lit(""))))), ", ")
    e_tail = F.when(e_pairs != "", F.concat(F.lit(", ["), e_pairs, F.lit("]"))).otherwise(F.lit(""))
    edges = _full_edges(g).select("bundle_id", F.lit(1).alias("section"), F.concat(verb, F.lit("("), named, F.col("arg1"), F.lit(", "), F.col("arg2"), more, e_tail, F.lit(")")).alias("record"))
    return nodes.unionByName(edges)


def _uri(name: Column, prefixes: dict[str, str]) -> Column:
    prefix = F.substring_index(name, ":", 1)
    base = _pick(prefix, prefixes)
    return F.when(name.contains("://"), name).when(name.contains(":"), F.concat(F.coalesce(base, F.concat(F.lit(EXAMPLE_URI), prefix, F.lit("/"))), F.substr(name, F.length(prefix) + 2))).otherwise(F.concat(F.lit(f"{EXAMPLE_URI}default/"), name))


def _prefixes(g: ProvGraph) -> dict[str, str]:
    """The registered prefixes; at most ten thousand are kept on the driver."""
    found = g.namespaces.limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("too many prefixes")
    return KNOWN_PREFIXES | {r.prefix: r.uri for r in found}


def ntriples(g: ProvGraph) -> DataFrame:
    """One N-Triples line per statement."""
    p = _prefixes(g)
    ref = lambda c: F.concat(F.lit("<"), _uri(c, p), F.lit(">"))
    rdf = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    n = g.nodes.filter("NOT is_placeholder").select("node_id", "kind", "types", "start_time", "end_time", ref(F.col("node_id")).alias("s"))
    s = F.col("s")
    line = lambda *parts: F.concat_ws(" ", *parts, F.lit("."))
    literal = lambda c: F.replace(F.replace(_quote(c), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    when = lambda c, name: F.when(F.col(c).isNotNull(), line(s, F.lit(f"<{PROV_URI}{name}>"), F.concat(F.lit('"'), _time(c), F.lit('"^^<http://www.w3.org/2001/XMLSchema#dateTime>'))))
    verb = _pick(F.col("relation"), {r.name: f"<{PROV_URI}{r.verb}>" for r in RELATIONS.values()})
    kind = line(s, F.lit(rdf), F.concat(F.lit(f"<{PROV_URI}"), F.initcap("kind"), F.lit(">")))
    types = F.transform(F.coalesce("types", F.array().cast("array<struct<prefix: string, local: string, uri: string>>")), lambda t: line(s, F.lit(rdf), F.concat(F.lit("<"), t["uri"], F.lit(">"))))
    own = g.attrs.filter((F.col("record_class") == "node") & ~F.coalesce(F.col("name").isin("prov:type", "prov:startTime", "prov:endTime"), F.lit(True)))
    parts = [
        n.select(F.explode(F.concat(F.array(kind), types, F.array_compact(F.array(when("start_time", "startedAtTime"), when("end_time", "endedAtTime"))))).alias("value")),
        n.select("node_id", "s").join(own.select("record_id", "name", "value"), F.col("node_id") == F.col("record_id")).select(line(s, ref(F.col("name")), literal(F.coalesce("value", F.lit("")))).alias("value")),
        g.edges.select(line(ref(F.col("arg1")), verb, ref(F.col("arg2"))).alias("value")),
    ]
    return reduce(DataFrame.union, parts)


def json_records(g: ProvGraph) -> DataFrame:
    """(bundle_id, section, id, record): the object of each record in PROV-JSON."""
    typed = lambda t: F.to_json(F.named_struct(F.lit("$"), _type_name(t), F.lit("type"), F.lit("prov:QUALIFIED_NAME")))
    text = lambda v: F.to_json(F.array(v))
    member = lambda k, v: F.concat(F.substring(text(k), F.lit(2), F.length(text(k)) - 2), F.lit(":"), v)

    def attributes(attrs: Column) -> Column:
        names = F.array_distinct(F.transform(attrs, lambda a: a["name"]))
        values = lambda n: F.to_json(F.transform(F.filter(attrs, lambda a: a["name"] == n), lambda a: F.coalesce(a["value"], F.lit(""))))
        return F.transform(names, lambda n: member(n, values(n)))

    quoted = lambda c: F.substring(text(c), F.lit(2), F.length(text(c)) - 2)
    types = F.when(F.size("types") > 0, F.array(F.concat(F.lit('"prov:type":['), F.array_join(F.transform("types", typed), ","), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    times = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"prov:{k}":"'), _time(c), F.lit('"'))) for c, k in (("start_time", "startTime"), ("end_time", "endTime"))]))
    nodes = _full_nodes(g).select("bundle_id", F.col("kind").alias("section"), F.col("node_id").alias("id"), F.concat(F.lit("{"), F.array_join(F.concat(types, times, attributes(F.col("attrs"))), ","), F.lit("}")).alias("record"))
    verb = _pick(F.col("relation"), {r.name: r.verb for r in RELATIONS.values()})
    ends = F.array(*[F.concat(F.lit('"prov:'), _pick(F.col("relation"), {k: v[i] for k, v in FORMAL.items()}), F.lit('":'), quoted(F.col(f"arg{i + 1}"))) for i in (0, 1)])
    edges = _full_edges(g).select("bundle_id", verb.alias("section"), F.when(F.col("edge_id").contains("|"), F.concat(F.lit("_:"), F.md5("edge_id"))).otherwise(F.col("edge_id")).alias("id"), F.concat(F.lit("{"), F.array_join(F.concat(ends, attributes(F.col("attrs"))), ","), F.lit("}")).alias("record"))
    return nodes.unionByName(edges)


def prov_json(g: ProvGraph) -> DataFrame:
    """One row: the whole document. One task assembles it, so it is for documents that fit one."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    put = lambda items: F.array_join(F.array_sort(F.collect_list(items)), ",")
    section = json_records(g).groupBy("bundle_id", "section").agg(put(F.concat(quoted(F.col("id")), F.lit(":"), F.col("record"))).alias("body"))
    bundle = section.groupBy("bundle_id").agg(put(F.concat(quoted(F.col("section")), F.lit(":{"), F.col("body"), F.lit("}"))).alias("body"))
    top = F.max(F.when(F.col("bundle_id").isNull(), F.col("body")))
    inner = put(F.when(F.col("bundle_id").isNotNull(), F.concat(quoted(F.col("bundle_id")), F.lit(":{"), F.col("body"), F.lit("}"))))
    prefix = g.namespaces.agg(put(F.concat(quoted(F.col("prefix")), F.lit(":"), quoted(F.col("uri")))).alias("p"))
    whole = bundle.agg(top.alias("top"), inner.alias("inner")).join(prefix)
    return whole.select(F.concat(F.lit('{"prefix":{'), "p", F.lit("}"), F.when(F.col("inner") != "", F.concat(F.lit(',"bundle":{'), "inner", F.lit("}"))).otherwise(F.lit("")), F.when(F.col("top").isNotNull(), F.concat(F.lit(","), "top")).otherwise(F.lit("")), F.lit("}")).alias("value"))


def _xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_records(g: ProvGraph) -> DataFrame:
    """(bundle_id, record): the element of each record in PROV-XML."""
    element = lambda n, v: F.concat(F.lit("<"), n, F.lit(">"), _xml_text(v), F.lit("</"), n, F.lit(">"))
    own = F.array_join(F.transform("attrs", lambda a: element(a["name"], F.coalesce(a["value"], F.lit("")))), "")
    types = F.array_join(F.transform("types", lambda t: F.concat(F.lit('<prov:type xsi:type="xsd:QName">'), _xml_text(_type_name(t)), F.lit("</prov:type>"))), "")
    times = F.concat(*[F.coalesce(F.concat(F.lit(f"<prov:{k}>"), _time(c), F.lit(f"</prov:{k}>")), F.lit("")) for c, k in (("start_time", "startTime"), ("end_time", "endTime"))])
    tag = F.concat(F.lit("prov:"), F.col("kind"))
    nodes = _full_nodes(g).select("bundle_id", F.concat(F.lit("<"), tag, F.lit(' prov:id="'), _xml_text(F.col("node_id")), F.lit('">'), times, types, own, F.lit("</"), tag, F.lit(">")).alias("record"))
    verb = F.concat(F.lit("prov:"), _pick(F.col("relation"), {r.name: r.verb for r in RELATIONS.values()}))
    ends = F.concat(*[F.concat(F.lit("<prov:"), _pick(F.col("relation"), {k: v[i] for k, v in FORMAL.items()}), F.lit(' prov:ref="'), _xml_text(F.col(f"arg{i + 1}")), F.lit('"/>')) for i in (0, 1)])
    named = F.when(F.col("edge_id").contains("|"), F.lit("")).otherwise(F.concat(F.lit(' prov:id="'), _xml_text(F.col("edge_id")), F.lit('"')))
    edges = _full_edges(g).select("bundle_id", F.concat(F.lit("<"), verb, named, F.lit(">"), ends, own, F.lit("</"), verb, F.lit(">")).alias("record"))
    return nodes.unionByName(edges)


def _by_bundle(rows: DataFrame) -> dict[str | None, list[str]]:
    out: dict[str | None, list[str]] = {}
    for r in rows.collect():
        out.setdefault(r.bundle_id, []).append(r.record)
    return out


def export(g: ProvGraph, formats: tuple[str, ...] = ("provn", "json", "xml", "rdf")) -> dict[str, str]:
    """Whole documents as strings, for graphs that fit the driver; an error is the format's text."""
    out = {}
    for name in formats:
        try:
            if name == "provn":
                parts = _by_bundle(provn_lines(g).orderBy("bundle_id", "section", "record"))
                lines = ["document", *(f"  prefix {p} <{u}>" for p, u in sorted(_prefixes(g).items())), *(f"  {x}" for x in parts.pop(None, []))]
                for bundle, records in parts.items():
                    lines += [f"  bundle {bundle}", *(f"    {x}" for x in records), "  endBundle"]
                out[name] = "\n".join([*lines, "endDocument"])
            elif name == "json":
                out[name] = prov_json(g).first().value
            elif name == "xml":
                spaces = " ".join(f'xmlns:{p}="{u}"' for p, u in sorted(_prefixes(g).items()))
                parts = _by_bundle(xml_records(g).orderBy("bundle_id", "record"))
                body = "".join(parts.pop(None, [])) + "".join(f'<prov:bundleContent prov:id="{b}">{"".join(r)}</prov:bundleContent>' for b, r in parts.items())
                out[name] = f'<?xml version="1.0" encoding="UTF-8"?><prov:document {spaces} xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{body}</prov:document>'
            elif name in ("rdf", "nt"):
                out[name] = "\n".join(r.value for r in ntriples(g).orderBy("value").collect())
            else:
                raise ValueError(f"unknown format {name!r}")
        except Exception as e:  # noqa: BLE001  the caller gets a text per format
            out[name] = f"Error: {e}"
    return out


def dot_lines(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """Graphviz statements for a drawing."""
    shape = _pick(F.col("kind"), {"entity": "ellipse", "activity": "box", "agent": "house"})
    n = g.nodes.select(F.concat(_quote(F.col("node_id")), F.lit(" [shape="), F.coalesce(shape, F.lit("point")), F.lit("];")).alias("value"))
    e = g.view(view).select(F.concat(_quote(F.col("src")), F.lit(" -> "), _quote(F.col("dst")), F.lit(" [label="), _quote(F.col("relation")), F.lit("];")).alias("value"))
    return n.union(e)


def template_json(templates: DataFrame) -> DataFrame:
    """(bundleName, value): each template as JSON without empty fields."""

    def full(c: Column) -> Column:
        return F.when(F.size(c) > 0, c)

    def slim(x: Column, *lists: str) -> Column:
        for name in lists:
            x = x.withField(name, full(x[name]))
        return x.withField("attributes", full(x["attributes"]))

    out = {"bundleName": F.col("bundleName"), "prefixes": full(F.col("prefixes")), "mainActivity": slim(F.col("mainActivity"), "used", "generated", "hasPart")}
    for name in ("backwardConnectors", "forwardConnectors"):
        out[name] = full(F.transform(name, lambda c: slim(c, "derivedFrom", "specializedBy")))
    for name in ("senderAgents", "receiverAgents", "currentAgents", "identifierEntities"):
        out[name] = full(F.transform(name, lambda x: slim(x)))
    return templates.select("bundleName", F.to_json(F.struct(*[c.alias(k) for k, c in out.items()])).alias("value"))


def write_templates(templates: DataFrame, path: str, check: bool = False) -> None:
    """One JSON line per template; with ``check``, only if no required field is missing."""
    if check:
        from ..operators.templates import check_templates

        check_templates(templates)
    template_json(templates).select("value").write.text(path)


def write_graph(g: ProvGraph, path: str) -> None:
    """The tables as Parquet; edges in a folder per relation, so that a filter on it reads one."""
    for name in ("nodes", "attrs", "namespaces", "bundles"):
        getattr(g, name).write.parquet(f"{path}/{name}")
    g.edges.write.partitionBy("relation").parquet(f"{path}/edges")
