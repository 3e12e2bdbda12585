"""Table layouts and fixed values of the provenance model."""

from __future__ import annotations

from dataclasses import dataclass

# Namespaces, types and attributes of the data model.
CPM_URI = "https://commonprovenancemodel.org/ns/cpm/"
PROV_URI = "http://www.w3.org/ns/prov#"
DCT_URI = "http://purl.org/dc/terms/"
XSD_URI = "http://www.w3.org/2001/XMLSchema#"
EXAMPLE_URI = "http://example.org/"
KNOWN_PREFIXES = {"cpm": CPM_URI, "dct": DCT_URI, "prov": PROV_URI, "xsd": XSD_URI}
DEFAULT_PREFIX, ATTRIBUTE_PREFIX = "default", "attr"
TRAVERSAL_TYPES = ("MainActivity", "BackwardConnector", "ForwardConnector", "SenderAgent", "ReceiverAgent", "CurrentAgent")
OTHER_TYPES = ("IdentifierEntity", "SubActivity", "StorageActivity")

TYPE = "struct<prefix: string, local: string, uri: string>"
NODES = f"bundle_id string, node_id string, kind string, types array<{TYPE}>, start_time timestamp, end_time timestamp, is_placeholder boolean, ordinal long"
EDGES = "bundle_id string, edge_id string, relation string, arg1 string, arg2 string, ordinal long"
ATTRS = "record_id string, record_class string, name string, value string, value_type string, ordinal long"
NAMESPACES = "prefix string, uri string"
BUNDLES = "bundle_id string"


@dataclass(frozen=True)
class Relation:
    """A relation kind: its PROV-N verb, the kinds of its two formal arguments, and its directions.

    ``wrap`` and ``doc`` tell which argument comes first in each view: (1, 2) or (2, 1). A kind
    without ``doc`` is not seen in the document view.
    """

    name: str
    verb: str
    kinds: tuple[str, str]
    wrap: tuple[int, int]
    doc: tuple[int, int] | None
    cost: float = 1.0
    aliases: tuple[str, ...] = ()


# The direction views, verbs and traversal costs of the 14 relation kinds.
RELATIONS = {
    r.name: r
    for r in (
        Relation("usage", "used", ("activity", "entity"), (2, 1), (2, 1), 1.0, ("use",)),
        Relation("generation", "wasGeneratedBy", ("entity", "activity"), (2, 1), (2, 1), 1.0, ("generated",)),
        Relation("attribution", "wasAttributedTo", ("entity", "agent"), (2, 1), (2, 1), 1.2),
        Relation("derivation", "wasDerivedFrom", ("entity", "entity"), (2, 1), (1, 2), 1.5, ("derived",)),
        Relation("association", "wasAssociatedWith", ("activity", "agent"), (2, 1), (1, 2), 1.2),
        Relation("communication", "wasInformedBy", ("activity", "activity"), (2, 1), (1, 2), 2.0),
        Relation("delegation", "actedOnBehalfOf", ("agent", "agent"), (2, 1), (1, 2), 2.0),
        Relation("influence", "wasInfluencedBy", ("any", "any"), (2, 1), (1, 2)),
        Relation("specialization", "specializationOf", ("entity", "entity"), (2, 1), (1, 2)),
        Relation("alternate", "alternateOf", ("entity", "entity"), (2, 1), (1, 2)),
        Relation("membership", "hadMember", ("entity", "entity"), (2, 1), (1, 2)),
        Relation("start", "wasStartedBy", ("activity", "entity"), (2, 1), None),
        Relation("end", "wasEndedBy", ("activity", "entity"), (2, 1), None),
        Relation("invalidation", "wasInvalidatedBy", ("entity", "activity"), (2, 1), None),
    )
}
CROSS_PART_FACTOR = 2.0


def relation_name(name: str) -> str:
    """Relation kind of a kind, a PROV verb or an alias in any case, e.g. ``wasDerivedFrom``."""
    low = name.lower().removeprefix("prov:").removeprefix("prov_")
    for r in RELATIONS.values():
        if low in (r.name, r.verb.lower(), *r.aliases):
            return r.name
    raise ValueError(f"unknown relation {name!r}")
