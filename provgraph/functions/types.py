"""Column predicates on node types and relations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CPM_URI, CROSS_PART_FACTOR, KNOWN_PREFIXES, RELATIONS, TRAVERSAL_TYPES, relation_name


def type_struct(name: str) -> Column:
    """A type literal from ``prefix:local``."""
    prefix, _, local = name.rpartition(":")
    uri = KNOWN_PREFIXES.get(prefix, f"http://example.org/{prefix}/" if prefix else "")
    return F.struct(F.lit(prefix or None).cast("string").alias("prefix"), F.lit(local).alias("local"), F.lit(f"{uri}{local}").alias("uri"))


def types_of(*names: str) -> Column:
    """An array of type literals; without names the empty array."""
    return F.array(*map(type_struct, names)) if names else no_types()


def no_types() -> Column:
    return F.array().cast("array<struct<prefix: string, local: string, uri: string>>")


def is_traversal(types: Column | str = "types", uris: Iterable[str] = (CPM_URI,)) -> Column:
    """Exact test: any type is one of the six of traversal information. Null types are not.

    ``uris`` lists the namespace URIs that count; data in the wild has more than one.
    """
    names = F.array(*[F.lit(f"{u}{t}") for u in uris for t in TRAVERSAL_TYPES])
    return F.coalesce(F.arrays_overlap(F.transform(types, lambda t: t["uri"]), names), F.lit(False))


def has_type(name: str, types: Column | str = "types") -> Column:
    """Loose test: any type with this name or local name, in any case."""
    full = name.lower()
    local = full.rpartition(":")[2]

    def same(t: Column) -> Column:
        return (F.lower(t["local"]) == local) | (F.lower(t["uri"]) == full)

    return F.coalesce(F.exists(types, same), F.lit(False))


def has_exact_type(uri: str, types: Column | str = "types") -> Column:
    return F.coalesce(F.exists(types, lambda t: t["uri"] == uri), F.lit(False))


def has_type_or_kind(name: str) -> Column:
    """Loose type test, or the record kind itself for entity, activity and agent."""
    low = name.lower().rpartition(":")[2]
    loose = has_type(name)
    return loose | (F.col("kind") == low) if low in ("entity", "activity", "agent") else loose


def pick_argument(view: str, place: int) -> Column:
    """Argument of a relation that comes first (0) or second (1) in a view; null where not seen."""
    rules = [(r.name, getattr(r, view)) for r in RELATIONS.values()]
    out = F.lit(None).cast("string")
    for order in {o for _, o in rules if o}:
        names = [n for n, o in rules if o == order]
        out = F.when(F.col("relation").isin(names), F.col(f"arg{order[place]}")).otherwise(out)
    return out


def is_relation(*names: str) -> Column:
    return F.col("relation").isin([relation_name(n) for n in names])


def prov_kind(relation: Column | str = "relation") -> Column:
    """``PROV_DERIVATION`` and so on; unknown classes in upper case."""
    return F.concat(F.lit("PROV_"), F.upper(relation))


def traversal_cost(relation: Column, cross_part: Column) -> Column:
    """Cost of a step along an edge, doubled between parts."""
    costs = {r.name: r.cost for r in RELATIONS.values() if r.cost != 1.0}
    base = reduce(lambda rest, x: F.when(relation == x[0], F.lit(x[1])).otherwise(rest), costs.items(), F.lit(1.0))
    return base * F.when(cross_part, F.lit(CROSS_PART_FACTOR)).otherwise(F.lit(1.0))
