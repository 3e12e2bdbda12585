"""The document facade: the graph operators as methods.

Methods that ask return DataFrames (or a row, a number, a truth value where one is asked for);
methods that edit return a new document.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .graph import ProvGraph, empty
from .operators import edit, merge, metrics, schedule, select, templates, traverse, validate
from .sinks import export
from .sources import formats, records


class ProvenanceDocument:
    """One provenance document over a ``ProvGraph``."""

    def __init__(self, graph: ProvGraph):
        self.graph = graph

    # --- construction

    @classmethod
    def empty(cls, spark: SparkSession) -> ProvenanceDocument:
        return cls(empty(spark))

    @classmethod
    def from_template(cls, template: DataFrame, domain_specific: ProvenanceDocument | None = None) -> ProvenanceDocument:
        return cls(templates.document_from_template(template, domain_specific.graph if domain_specific else None))

    @classmethod
    def import_from_formats(cls, spark: SparkSession, content: str, format_name: str = "json") -> ProvenanceDocument:
        return cls(formats.import_document(spark, content, format_name))

    @classmethod
    def create_simple_graph(cls, spark: SparkSession, entities: Iterable[str], activities: Iterable[tuple[str, str, str]]) -> ProvenanceDocument:
        return cls(records.simple_graph(spark, entities, activities))

    # --- nodes

    def get_nodes(self, identifier: str | None = None) -> DataFrame:
        return self.graph.nodes if identifier is None else select.nodes_by_id(self.graph, identifier)

    get_all_nodes = get_nodes

    def get_node(self, identifier: str) -> Row | None:
        return select.node(self.graph, identifier)

    def get_nodes_by_type(self, prov_type: str) -> DataFrame:
        return select.nodes_by_type(self.graph, prov_type)

    def get_nodes_by_attribute(self, name: str, value: str | None = None) -> DataFrame:
        return select.nodes_by_attribute(self.graph, name, value)

    def get_nodes_map(self) -> DataFrame:
        return select.nodes_map(self.graph)

    def get_node_by_element(self, identifier: str, kind: str, bundle_id: str | None = None) -> DataFrame:
        return select.nodes_by_element(self.graph, identifier, kind, bundle_id)

    def get_node_by_id_and_kind(self, identifier: str, kind: str) -> DataFrame:
        return select.nodes_by_id_and_kind(self.graph, identifier, kind)

    def get_prov_attribute(self, identifier: str, name: str) -> DataFrame:
        return select.attribute_values(self.graph, identifier, name)

    def get_main_activity(self) -> Row | None:
        return select.main_activity(self.graph).first()

    def get_forward_connectors(self) -> DataFrame:
        return select.forward_connectors(self.graph)

    def get_backward_connectors(self) -> DataFrame:
        return select.backward_connectors(self.graph)

    def get_current_agents(self) -> DataFrame:
        return select.current_agents(self.graph)

    def get_traversal_information_nodes(self) -> DataFrame:
        return select.traversal_nodes(self.graph)

    def get_domain_specific_nodes(self) -> DataFrame:
        return select.domain_nodes(self.graph)

    def get_traversal_information_part(self) -> ProvenanceDocument:
        return ProvenanceDocument(traverse.traversal_part(self.graph))

    def get_connected_nodes(self, identifier: str, relation_types: list[str] | None = None) -> DataFrame:
        return select.connected_nodes(self.graph, identifier, relation_types)

    def get_neighbors(self, identifier: str, direction: str = "both") -> DataFrame:
        return select.neighbours(self.graph, identifier, direction)

    def __len__(self) -> int:
        return self.graph.count()

    # --- edges

    def get_edges(self, source_id: str | None = None, target_id: str | None = None, relation_type: str | None = None) -> DataFrame:
        return select.edges(self.graph, source_id, target_id, relation_type)

    get_all_edges = get_edges

    def get_edge(self, source: str, target: str, relation_type: str | None = None) -> Row | None:
        return select.edge(self.graph, source, target, relation_type)

    def get_edges_by_id(self, identifier: str) -> DataFrame:
        return select.edges_by_id(self.graph, identifier)

    def get_edge_by_id(self, identifier: str) -> Row | None:
        return select.edges_by_id(self.graph, identifier).first()

    def get_edge_with_kind(self, identifier: str, kind: str | None = None) -> DataFrame:
        return select.edge_with_kind(self.graph, identifier, kind)

    def get_edges_by_relation(self, relation: str, arg1: str, arg2: str) -> DataFrame:
        return select.edges_by_relation(self.graph, relation, arg1, arg2)

    def get_cross_part_edges(self) -> DataFrame:
        return select.cross_part_edges(self.graph)

    def detect_cross_part_edges(self) -> DataFrame:
        return select.cross_bundle_edges(self.graph)

    def get_traversal_information(self) -> DataFrame:
        return select.traversal_information(self.graph)

    def are_all_relations_mapped(self) -> bool:
        return select.are_all_relations_mapped(self.graph)

    # --- edits

    def add_node(self, node_type: str, identifier: str, attributes: Mapping[str, Any] | None = None, prov_type: str | None = None, **options: Any) -> ProvenanceDocument:
        return ProvenanceDocument(edit.add_node(self.graph, node_type, identifier, attributes, prov_type, **options))

    def remove_node(self, identifier: str, node_type: str | None = None) -> ProvenanceDocument:
        return ProvenanceDocument(edit.remove_node(self.graph, identifier, node_type))

    def remove_nodes(self, *identifiers: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.remove_nodes(self.graph, *identifiers))

    def remove_node_by_kind(self, identifier: str, kind: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.remove_node_by_kind(self.graph, identifier, kind))

    def update_node_identifier(self, old: str, new: str, keep_edges: bool = True) -> ProvenanceDocument:
        return ProvenanceDocument(edit.rename_node(self.graph, old, new, keep_edges))

    def add_edge(self, relation_type: str, source: str, target: str, edge_id: str | None = None, attributes: Mapping[str, Any] | None = None) -> ProvenanceDocument:
        return ProvenanceDocument(edit.add_edge(self.graph, relation_type, source, target, edge_id, attributes))

    def remove_edge(self, source: str, target: str, relation_type: str | None = None) -> ProvenanceDocument:
        return ProvenanceDocument(edit.remove_edge(self.graph, source, target, relation_type)[0])

    def remove_edges(self, source: str | None = None, target: str | None = None, relation_type: str | None = None) -> tuple[ProvenanceDocument, int]:
        graph, n = edit.remove_edges(self.graph, source, target, relation_type)
        return ProvenanceDocument(graph), n

    def remove_edge_by_id(self, identifier: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.remove_edges(self.graph, edge_id=identifier)[0])

    def remove_edges_by_kind(self, kind: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.remove_edges(self.graph, relation=kind)[0])

    def set_new_cause_and_effect(self, edge_id: str, cause: str, effect: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.repoint(self.graph, edge_id, cause, effect))

    def set_new_cause_and_effect_by_kind(self, relation: str, old_cause: str, old_effect: str, cause: str, effect: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.repoint_by_kind(self.graph, relation, old_cause, old_effect, cause, effect))

    def set_collection_members(self, collection: str, members: list[str], check: bool = False) -> ProvenanceDocument:
        return ProvenanceDocument(edit.set_collection_members(self.graph, collection, members, check))

    def get_bundle_id(self) -> str | None:
        return self.graph.bundles.agg(F.min("bundle_id")).first()[0]

    def set_bundle_id(self, bundle_id: str) -> ProvenanceDocument:
        return ProvenanceDocument(edit.set_bundle_id(self.graph, bundle_id))

    def get_namespaces(self) -> DataFrame:
        return self.graph.namespaces

    def clear(self) -> ProvenanceDocument:
        return ProvenanceDocument(edit.clear(self.graph))

    # --- traversal

    def get_predecessors(self, identifier: str | DataFrame | None = None, relation_types: Iterable[str] | None = None, max_depth: int | None = None) -> DataFrame:
        return traverse.predecessors(self.graph, identifier, relation_types, max_depth)

    def get_successors(self, identifier: str | DataFrame | None = None, relation_types: Iterable[str] | None = None, max_depth: int | None = None) -> DataFrame:
        return traverse.successors(self.graph, identifier, relation_types, max_depth)

    def get_connected_components(self) -> DataFrame:
        return traverse.connected_components(self.graph)

    def find_paths(self, source: str, target: str, max_length: int | None = None) -> DataFrame:
        pairs = self.graph.spark.createDataFrame([(source, target)], "source string, target string")
        return traverse.find_paths(self.graph, pairs, max_length)

    def get_precursors(self, connector_id: str | None = None) -> DataFrame:
        return traverse.precursors(self.graph, connector_id)

    def get_successors_connectors(self, connector_id: str | None = None) -> DataFrame:
        return traverse.successor_connectors(self.graph, connector_id)

    def get_related_connectors(self, connector_id: str | None = None, direction: str = "both") -> DataFrame:
        return traverse.related_connectors(self.graph, connector_id, direction)

    def get_subgraph(self, node_ids: Iterable[str] | DataFrame, include_edges: bool = True) -> ProvenanceDocument:
        g = traverse.subgraph(self.graph, node_ids)
        return ProvenanceDocument(g if include_edges else g.with_(edges=g.edges.limit(0)))

    def create_subgraph(self, condition: Column) -> ProvenanceDocument:
        return ProvenanceDocument(traverse.subgraph_where(self.graph, condition))

    def get_influence_network(self) -> DataFrame:
        return traverse.influence_network(self.graph)

    def find_critical_paths(self) -> DataFrame:
        return traverse.critical_paths(self.graph)

    # --- metrics and schedule

    def get_statistics(self) -> dict[str, int]:
        return metrics.statistics(self.graph).first().asDict()

    def analyze_provenance_chains(self) -> dict[str, Any]:
        return metrics.chain_statistics(self.graph).first().asDict() | {"circular_dependencies": traverse.circular_dependencies(self.graph)}

    def compute_centrality_metrics(self) -> DataFrame:
        return metrics.degree_centrality(self.graph)

    def analyze_document_complexity(self) -> dict[str, Any]:
        return metrics.complexity(self.graph).first().asDict() | {"hub_nodes": metrics.hubs(self.graph)}

    def get_graph_statistics(self) -> dict[str, Any]:
        return metrics.graph_statistics(self.graph).first().asDict()

    def compute_graph_metrics(self) -> dict[str, Any]:
        """The eight metrics; the per-node ones as tables."""
        g = self.graph
        return metrics.adjacency_metrics(g).first().asDict() | {
            "connected_components": metrics.linked_components(g), "diameter": metrics.diameter(g).first()[0], "clustering_coefficient": metrics.clustering(g).first()[0],
            "degree": metrics.degree_centrality(g), "betweenness": metrics.betweenness(g), "closeness": metrics.closeness(g), "priority": metrics.priority_centrality(g), "node_types": metrics.type_counts(g),
        }

    def compute_influence_scores(self) -> DataFrame:
        return metrics.influence_scores(self.graph)

    def detect_anomalies(self) -> DataFrame:
        return metrics.anomalies(self.graph)

    def compute_node_priorities(self, temporal: bool = False) -> DataFrame:
        return schedule.priorities(self.graph, temporal)

    def get_execution_order(self) -> DataFrame:
        return schedule.execution_order(self.graph)

    def find_highest_priority_nodes(self, count: int = 5) -> DataFrame:
        return schedule.top_priorities(schedule.priorities(self.graph), count)

    def find_lowest_priority_nodes(self, count: int = 5) -> DataFrame:
        return schedule.top_priorities(schedule.priorities(self.graph), count, highest=False)

    def diagnose_priority_issues(self) -> DataFrame:
        return schedule.priority_issues(self.graph)

    # --- sets

    def clone(self) -> ProvenanceDocument:
        return ProvenanceDocument(merge.clone(self.graph))

    def merge_with(self, other: ProvenanceDocument, conflict_resolution: str = "keep_first", nodes_only: bool = False) -> ProvenanceDocument:
        return ProvenanceDocument(merge.merge_documents(self.graph, other.graph, conflict_resolution, nodes_only))

    def merge_graphs(self, *others: ProvenanceDocument) -> ProvenanceDocument:
        return ProvenanceDocument(merge.merge_graphs(self.graph, *[o.graph for o in others]))

    def filter_by_time_range(self, start_time: str | None = None, end_time: str | None = None) -> ProvenanceDocument:
        return ProvenanceDocument(merge.filter_by_time(self.graph, start_time, end_time))

    def equals(self, other: ProvenanceDocument, strict: bool = False) -> bool:
        return merge.equal_content(self.graph, other.graph) if strict else merge.equal_counts(self.graph, other.graph)

    def hash_code(self) -> str:
        return merge.stable_hash(self.graph).first()[0]

    # --- validation and export

    def validate(self, template: DataFrame | None = None) -> validate.Report:
        return validate.validate(self.graph, template)

    def validate_structure(self) -> DataFrame:
        return validate.structure(self.graph)

    def validate_constraints(self) -> DataFrame:
        return validate.constraints(self.graph)

    def export_to_formats(self, formats: tuple[str, ...] = ("provn", "json", "xml")) -> dict[str, str]:
        return export.export(self.graph, formats)
