"""Validation: rules are functions from a graph to a table of findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import is_relation, is_traversal
from ..graph import ProvGraph
from ..plans import fixpoint
from ..plans.scratch import materialize
from ..schema import CROSS_PART_FACTOR, RELATIONS
from . import select, traverse

FINDINGS = "level string, type string, code string, message string, node_id string, edge_id string, bundle_id string, rule string"
Rule = Callable[[ProvGraph], DataFrame]

# Level, type and text of every finding. {} is filled from the finding's row.
CATALOGUE = {
    "no_main_activity": ("ERROR", "STRUCTURAL", "Document contains no Main Activity"),
    "multiple_main_activities": ("ERROR", "STRUCTURAL", "Document contains multiple Main Activities: {}"),
    "connector_missing_bundle_id": ("ERROR", "STRUCTURAL", "Connector {} missing required cpm:referencedBundleId"),
    "connector_missing_hash": ("WARNING", "STRUCTURAL", "Connector {} missing cpm:referencedBundleHashValue"),
    "backward_connector_not_used": ("ERROR", "STRUCTURAL", "Backward Connector {} not used by Main Activity"),
    "forward_connector_not_generated": ("ERROR", "STRUCTURAL", "Forward Connector {} not generated by Main Activity"),
    "graph_not_connected": ("ERROR", "TRAVERSAL", "Graph not fully connected: {} nodes reachable"),
    "orphaned_node": ("WARNING", "STRUCTURAL", "Node {} is not reachable from the Main Activity"),
    "invalid_usage_relation": ("ERROR", "SEMANTIC", "Invalid Usage relation: expected Entity -> Activity, got {}"),
    "invalid_generation_relation": ("ERROR", "SEMANTIC", "Invalid Generation relation: expected Activity -> Entity, got {}"),
    "invalid_association_relation": ("ERROR", "SEMANTIC", "Invalid Association relation: expected Activity -> Agent, got {}"),
    "node_missing_identifier": ("ERROR", "STRUCTURAL", "Node missing identifier"),
    "node_no_elements": ("ERROR", "STRUCTURAL", "Node has no elements"),
    "isolated_node": ("WARNING", "STRUCTURAL", "Isolated node detected"),
    "edge_missing_cause": ("ERROR", "STRUCTURAL", "Edge missing cause node"),
    "edge_missing_effect": ("ERROR", "STRUCTURAL", "Edge missing effect node"),
    "edge_no_relations": ("ERROR", "STRUCTURAL", "Edge has no relations"),
    "self_loop_edge": ("WARNING", "STRUCTURAL", "Self-loop edge detected"),
    "empty_bundle": ("WARNING", "STRUCTURAL", "Empty bundle detected"),
    "no_bundles": ("INFO", "STRUCTURAL", "No bundles found in document"),
    "inconsistent_node_types": ("WARNING", "SEMANTIC", "Node has elements with inconsistent types: {}"),
    "cross_part_not_marked": ("ERROR", "CROSS_PART", "Cross-part edge not properly marked"),
    "high_traversal_cost": ("WARNING", "TRAVERSAL", "High traversal cost: {}"),
    "template_missing_main_activity": ("ERROR", "TEMPLATE_COMPLIANCE", "Missing required main activity"),
    "template_missing_backward_connectors": ("WARNING", "TEMPLATE_COMPLIANCE", "Template specifies backward connectors but none found in graph"),
    "template_missing_forward_connectors": ("WARNING", "TEMPLATE_COMPLIANCE", "Template specifies forward connectors but none found in graph"),
    "no_ti_nodes": ("ERROR", "STRUCTURAL", "No traversal information nodes found"),
    "no_ds_nodes": ("INFO", "STRUCTURAL", "No domain-specific nodes found - consider adding domain context"),
    "validation_rule_failed": ("ERROR", "STRUCTURAL", "Validation rule failed: {}"),
}
HIGH_COST = 10.0
#: So many main activities are named in a message; all of them are rows of ``select.main_activities``.
NAMED = 20


def finding(rows: DataFrame, code: str, fill: Column | None = None, node_id: Column | None = None, edge_id: Column | None = None, bundle_id: Column | None = None) -> DataFrame:
    """A finding per row."""
    level, kind, text = CATALOGUE[code]
    before, _, after = text.partition("{}")
    message = F.lit(text) if fill is None else F.concat(F.lit(before), F.coalesce(fill.cast("string"), F.lit("null")), F.lit(after))
    null = F.lit(None).cast("string")
    pick = lambda c: null if c is None else c.cast("string")
    return rows.select(
        F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit(code).alias("code"), message.alias("message"), pick(node_id).alias("node_id"), pick(edge_id).alias("edge_id"), pick(bundle_id).alias("bundle_id"), null.alias("rule")
    )


def _all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


# Bits of ``node_facts``: of kinds, and of what the edges at a node ask of it.
_KIND_BITS = {"entity": 1, "agent": 2, "activity": 4, "unknown": 8}
_OTHER_KIND, _IS_END = 16, 1
_END_BITS = {("usage", 0): 2, ("usage", 1): 4, ("generation", 0): 8, ("generation", 1): 16, ("association", 0): 32, ("association", 1): 64}


def node_facts(g: ProvGraph) -> DataFrame:
    """(node_id, number, n_rows, kinds, ends) of every id that is a node or an end: its number, its records, bits of their
    kinds, and bits of its places in edges. One shuffle, written once for all rules that ask for it.
    """
    if (known := g.__dict__.get("_facts")) is None:
        kind = reduce(lambda rest, k: F.when(F.col("kind") == k[0], k[1]).otherwise(rest), _KIND_BITS.items(), F.when(F.col("kind").isNull(), 0).otherwise(_OTHER_KIND))

        def bits(arg: int) -> Column:
            asked = {r: b for (r, place), b in _END_BITS.items() if RELATIONS[r].wrap[place] == arg}
            return reduce(lambda rest, k: F.when(F.col("relation") == k[0], k[1] | _IS_END).otherwise(rest), asked.items(), F.lit(_IS_END))

        ends = [g.edges.select(F.col(f"arg{k}").alias("node_id"), F.lit(0).alias("n_rows"), F.lit(0).alias("kinds"), bits(k).alias("ends")).filter("node_id IS NOT NULL") for k in (1, 2)]
        rows = g.nodes.select("node_id", F.lit(1).alias("n_rows"), kind.alias("kinds"), F.lit(0).alias("ends"))
        by = _all(rows, *ends).groupBy("node_id").agg(F.sum("n_rows").alias("n_rows"), F.bit_or("kinds").alias("kinds"), F.bit_or("ends").alias("ends"))
        known = g.__dict__["_facts"] = materialize(by.select("node_id", fixpoint.number_of("node_id").alias("number"), "n_rows", "kinds", "ends"), "node-facts")
    return known


def node_integrity(g: ProvGraph) -> DataFrame:
    n = g.nodes
    isolated = node_facts(g).filter("ends = 0").select("node_id", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))  # a row per record
    return _all(
        finding(n.filter("node_id IS NULL OR node_id = ''"), "node_missing_identifier", node_id=F.col("node_id")),
        finding(n.filter("is_placeholder"), "node_no_elements", node_id=F.col("node_id")),
        finding(isolated, "isolated_node", node_id=F.col("node_id")),
    )


def edge_integrity(g: ProvGraph) -> DataFrame:
    e, i = g.directed, F.col("edge_id")
    return _all(
        finding(e.filter("cause IS NULL"), "edge_missing_cause", edge_id=i),
        finding(e.filter("effect IS NULL"), "edge_missing_effect", edge_id=i),
        finding(e.filter("relation IS NULL"), "edge_no_relations", edge_id=i),
        finding(e.filter("cause = effect"), "self_loop_edge", edge_id=i),
    )


def kind_constraints(g: ProvGraph, strict_reference: bool = False) -> DataFrame:
    """Kinds at the ends of usage, generation and association, in the wrap view.

    An association runs from agent to activity there; ``strict_reference`` asks for the opposite.
    """
    association = ("activity", "agent") if strict_reference else ("agent", "activity")
    rules = {"usage": ("entity", "activity"), "generation": ("activity", "entity"), "association": association}
    wrong = reduce(lambda x, y: x | y, [(F.col("ends").bitwiseAND(b) != 0) & (F.col("kinds").bitwiseAND(31 - _KIND_BITS[rules[r][place]]) != 0) for (r, place), b in _END_BITS.items()])
    bad = materialize(node_facts(g).filter(wrong).select(F.col("node_id").alias("_bad")), "nodes-of-wrong-kind")
    e = g.view("wrap").filter(is_relation(*rules))
    at = lambda rows, end, how: rows.join(bad, F.col(end) == F.col("_bad"), how)
    suspect = materialize(at(e, "src", "left_semi").unionByName(at(at(e, "src", "left_anti"), "dst", "left_semi")), "edges-of-wrong-kind")
    e = select._with_ends(suspect, g.nodes, "kind")
    got = F.concat(F.initcap("src_kind"), F.lit(" -> "), F.initcap("dst_kind"))
    return _all(*[finding(e.filter((F.col("relation") == r) & ~((F.col("src_kind") == a) & (F.col("dst_kind") == b))), f"invalid_{r}_relation", got, edge_id=F.col("edge_id")) for r, (a, b) in rules.items()])


def cross_part_consistency(g: ProvGraph) -> DataFrame:
    """Only relations that can cost so much are looked at."""
    dear = [r.name for r in RELATIONS.values() if r.cost * CROSS_PART_FACTOR > HIGH_COST]
    info = select.traversal_information(g.with_(edges=g.edges.filter(F.col("relation").isin(dear) if dear else F.lit(False))))
    return finding(info.filter(F.col("cost") > HIGH_COST), "high_traversal_cost", F.col("cost"), edge_id=F.col("edge_id"))


def connectivity(g: ProvGraph) -> DataFrame:
    """One finding if the component of the first node does not have all nodes.

    Components are of numbers, as nobody asks for their names; ids that share a number get another seed.
    """
    facts, seed = node_facts(g).filter("node_id IS NOT NULL"), 0
    number = F.col("number")
    while not facts.groupBy(number.alias("number")).count().filter("count > 1").isEmpty():
        seed += 1
        number = fixpoint.number_of("node_id", seed)
    member = fixpoint.contract(g.view("wrap").select(fixpoint.number_of("src", seed).alias("a"), fixpoint.number_of("dst", seed).alias("b")))
    first = g.nodes.filter("node_id IS NOT NULL").agg(F.min(F.struct("ordinal", "node_id")).alias("first")).select(fixpoint.number_of("first.node_id", seed).alias("_first"), F.col("first").isNotNull().alias("some"))
    rows = facts.filter("n_rows > 0").select(number.alias("number"), "n_rows")
    if member is not None:
        rows = rows.join(member.select(F.col("node").alias("_node"), "root"), F.col("number") == F.col("_node"), "left")
    by = rows.groupBy((F.col("number") if member is None else F.coalesce("root", "number")).alias("root")).agg(F.sum("n_rows").alias("n"))
    if member is not None:
        first = first.join(member.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("_first") == F.col("_node"), "left").withColumn("_first", F.coalesce("_root", "_first"))
    whole = by.join(F.broadcast(first.filter("some").select("_first"))).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("root") == F.col("_first"), F.col("n"))).alias("reachable"))
    return finding(whole.filter("reachable < total"), "graph_not_connected", F.concat_ws("/", "reachable", "total"))


def bundle_structure(g: ProvGraph) -> DataFrame:
    used = g.nodes.select("bundle_id").union(g.edges.select("bundle_id")).distinct()
    none = g.bundles.agg(F.count("*").alias("n")).filter("n = 0")
    return _all(finding(g.bundles.join(used, "bundle_id", "left_anti"), "empty_bundle", bundle_id=F.col("bundle_id")), finding(none, "no_bundles"))


def attribute_consistency(g: ProvGraph) -> DataFrame:
    several = node_facts(g).filter((F.bit_count("kinds") > 1) | (F.col("kinds").bitwiseAND(_OTHER_KIND) != 0))
    several = materialize(several.select(F.col("node_id").alias("_several")), "nodes-of-several-kinds")
    rows = g.nodes.join(several, F.col("node_id").eqNullSafe(F.col("_several")), "left_semi")
    by = rows.groupBy("node_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).filter(F.size("kinds") > 1)
    return finding(by, "inconsistent_node_types", F.concat_ws(", ", "kinds"), node_id=F.col("node_id"))


RULES: dict[str, Rule] = {
    f.__name__: f for f in (node_integrity, edge_integrity, kind_constraints, cross_part_consistency, connectivity, bundle_structure, attribute_consistency)
}


def template_compliance(template: DataFrame) -> Rule:
    """What a template (one row, see the template source) asks for and the graph lacks."""

    def rule(g: ProvGraph) -> DataFrame:
        def lacks(name: str) -> DataFrame:
            # a substring test, as types come in several spellings
            there = g.nodes.filter(F.exists("types", lambda t: F.lower(t["local"]).contains(name.lower())))
            return there.agg(F.count("*").alias("n")).filter("n = 0")

        want = lambda c: template.agg(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias("wanted")).filter("wanted > 0")
        return _all(
            finding(lacks("MainActivity"), "template_missing_main_activity"),
            finding(lacks("BackwardConnector").join(want("backwardConnectors")), "template_missing_backward_connectors"),
            finding(lacks("ForwardConnector").join(want("forwardConnectors")), "template_missing_forward_connectors"),
        )

    rule.__name__ = "template_compliance"
    return rule


def rule_of(check: Callable[[ProvGraph], DataFrame], level: str = "ERROR", kind: str = "SEMANTIC", name: str | None = None) -> Rule:
    """A rule from a function that returns a table with ``message`` (and ids, where it has them)."""

    def rule(g: ProvGraph) -> DataFrame:
        rows = check(g)
        own = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c)
        return rows.select(F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit("custom").alias("code"), "message", own("node_id"), own("edge_id"), own("bundle_id"), F.lit(None).cast("string").alias("rule"))

    rule.__name__ = name or check.__name__
    return rule


class Validator:
    """A set of named rules; a rule that raises becomes a finding."""

    def __init__(self, rules: dict[str, Rule] | None = None):
        self.rules = dict(RULES if rules is None else rules)

    def add_rule(self, rule: Rule, name: str | None = None) -> None:
        self.rules[name or rule.__name__] = rule

    def remove_rule(self, name: str) -> None:
        self.rules.pop(name, None)

    def findings(self, g: ProvGraph, template: DataFrame | None = None) -> DataFrame:
        g = g.materialized("nodes", "edges")  # every rule reads the same tables; none of RULES reads attributes
        rules = dict(self.rules)
        if template is not None:
            rules["template_compliance"] = template_compliance(template)
        out = []
        for name, rule in rules.items():
            try:
                # written one by one, so that the driver never plans all rules at once
                found = materialize(rule(g), "findings")
            except Exception as e:  # noqa: BLE001  a broken rule is itself a finding
                found = finding(g.spark.range(1), "validation_rule_failed", F.lit(str(e)))
            out.append(found.withColumn("rule", F.lit(name)))
        return _all(*out)

    def validate(self, g: ProvGraph, template: DataFrame | None = None) -> Report:
        return Report(self.findings(g, template))


class Report:
    """Findings and their counts; the graph is valid without an ERROR."""

    def __init__(self, findings: DataFrame):
        self.findings = findings

    @property
    def counts(self) -> DataFrame:
        return self.findings.agg(*[F.count_if(F.col("level") == x).alias(f"{x.lower()}_count") for x in ("ERROR", "WARNING", "INFO")]).withColumn("is_valid", F.col("error_count") == 0)

    @property
    def is_valid(self) -> bool:
        return self.errors().isEmpty()

    def errors(self) -> DataFrame:
        return self.findings.filter("level = 'ERROR'")

    def warnings(self) -> DataFrame:
        return self.findings.filter("level = 'WARNING'")

    def by_type(self, kind: str) -> DataFrame:
        return self.findings.filter(F.col("type") == kind)


def validate(g: ProvGraph, template: DataFrame | None = None) -> Report:
    return Validator().validate(g, template)


def _lacking(g: ProvGraph, nodes: DataFrame, attribute: str) -> DataFrame:
    has = g.attrs.filter((F.col("record_class") == "node") & (F.col("name") == attribute) & F.col("value").isNotNull())
    return nodes.join(has.select(F.col("record_id").alias("node_id")), "node_id", "left_anti")


def structure(g: ProvGraph, orphans: bool = True) -> DataFrame:
    """Findings with the list they belong to: ``errors``, ``warnings`` or ``info``.

    A missing or doubled main activity is listed under warnings although its level is ERROR, an
    orphan under info although its level is WARNING. Connectors are held against the first main
    activity.
    """
    g = g.materialized()
    mains = select.main_activities(g)
    some_ids = mains.select("node_id").orderBy("node_id").limit(NAMED).agg(F.array_join(F.sort_array(F.collect_list("node_id")), ", ").alias("ids"))
    count = mains.agg(F.count("*").alias("n")).join(some_ids)
    count = count.withColumn("ids", F.when(F.col("n") > NAMED, F.concat("ids", F.lit(" and "), F.col("n") - NAMED, F.lit(" more"))).otherwise(F.col("ids")))
    forward, backward = select.forward_connectors(g), select.backward_connectors(g)
    both = forward.unionByName(backward)
    main = select.main_activity(g).select(F.col("node_id").alias("main"))
    e = g.edges
    used = e.filter(is_relation("usage")).join(main, e.arg1 == F.col("main"), "left_semi").select(F.col("arg2").alias("node_id"))
    made = e.filter(is_relation("generation")).join(main, e.arg2 == F.col("main"), "left_semi").select(F.col("arg1").alias("node_id"))
    some = main.agg(F.count("*").alias("n")).filter("n > 0").select("n")
    n = F.col("node_id")
    parts = [
        ("warnings", finding(count.filter("n = 0"), "no_main_activity")),
        ("warnings", finding(count.filter("n > 1"), "multiple_main_activities", F.col("ids"))),
        ("errors", finding(_lacking(g, both, "cpm:referencedBundleId"), "connector_missing_bundle_id", n, node_id=n)),
        ("warnings", finding(_lacking(g, both, "cpm:referencedBundleHashValue"), "connector_missing_hash", n, node_id=n)),
        ("errors", finding(backward.join(used, "node_id", "left_anti").join(some), "backward_connector_not_used", n, node_id=n)),
        ("errors", finding(forward.join(made, "node_id", "left_anti").join(some), "forward_connector_not_generated", n, node_id=n)),
    ]
    if orphans:
        parts.append(("info", finding(select.isolated_nodes(g), "orphaned_node", n, node_id=n)))
    return _all(*[found.withColumn("bucket", F.lit(bucket)) for bucket, found in parts])


def constraints(g: ProvGraph) -> DataFrame:
    """Findings as ``critical_errors``, ``warnings`` and ``recommendations``."""
    base = structure(g, orphans=False)
    critical = (F.col("bucket") == "errors") | (F.col("code") == "no_main_activity")
    base = base.withColumn("bucket", F.when(critical, F.lit("critical_errors")).otherwise(F.lit("warnings")))
    ti = g.nodes.agg(F.count_if(is_traversal()).alias("ti"), F.count_if(~is_traversal()).alias("ds"))
    return _all(
        base,
        finding(ti.filter("ti = 0"), "no_ti_nodes").withColumn("bucket", F.lit("critical_errors")),
        finding(ti.filter("ds = 0"), "no_ds_nodes").withColumn("bucket", F.lit("recommendations")),
    )


def unreachable_nodes(g: ProvGraph) -> DataFrame:
    """Nodes outside the component of every main activity."""
    c = traverse.connected_components(g)
    main = select.main_activities(g).select(F.col("node_id").alias("m"))
    good = c.join(main, F.col("node_id") == F.col("m"), "left_semi").select("component").distinct()
    return c.join(good, "component", "left_anti").select("node_id")
