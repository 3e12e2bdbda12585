"""Errors of guarded lookups and edits."""


class ProvenanceError(Exception):
    """Base of all errors of this package."""


class NodeNotFoundError(ProvenanceError):
    """A node that an operation needs is not there."""


class MultipleNodesError(ProvenanceError):
    """More than one node matches where one is asked for."""


class EdgeNotFoundError(ProvenanceError):
    """An edge that an operation needs is not there."""


class MultipleEdgesError(ProvenanceError):
    """More than one edge matches where one is asked for."""


class InvalidOperationError(ProvenanceError):
    """An edit that the model does not allow."""


class TemplateError(ProvenanceError):
    """A template that cannot be read or does not meet its schema."""
