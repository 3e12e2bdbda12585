"""Qualified names and time strings as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTRIBUTE_PREFIX, DEFAULT_PREFIX, EXAMPLE_URI, KNOWN_PREFIXES


def prefix_of(name: Column) -> Column:
    """What stands before the first colon; null without one. A name with ``://`` has none."""
    return F.when(name.contains(":") & ~name.contains("://"), F.split(name, ":", 2)[0])


def local_of(name: Column) -> Column:
    return F.when(prefix_of(name).isNull(), name).otherwise(F.split(name, ":", 2)[1])


def _known(prefix: Column) -> Column:
    out = F.concat(F.lit(EXAMPLE_URI), prefix, F.lit("/"))
    for k, uri in KNOWN_PREFIXES.items():
        out = F.when(prefix == k, F.lit(uri)).otherwise(out)
    return out


def qualified(name: Column, registered: Callable[[Column], Column], default: str = DEFAULT_PREFIX) -> Column:
    """(prefix, local, uri) of a name: registered prefix, known prefix, example URI, default. ``registered`` gives the URI of a prefix."""
    prefix = F.when(~name.contains("://") | name.isNull(), F.coalesce(prefix_of(name), F.lit(default)))
    uri = F.when(prefix.isNull(), name).otherwise(F.concat(F.coalesce(registered(prefix), _known(prefix)), local_of(name)))
    local = F.when(prefix.isNull(), F.element_at(F.split(name, "[/#]"), -1)).otherwise(local_of(name))
    return F.struct(prefix.alias("prefix"), local.alias("local"), uri.alias("uri"))


def resolve(rows: DataFrame, column: str, namespaces: DataFrame, default: str = DEFAULT_PREFIX) -> DataFrame:
    """Add ``<column>_qname`` (prefix, local, uri), with the namespaces joined."""
    name = F.col(column)
    own = namespaces.select(F.col("prefix").alias("_prefix"), F.col("uri").alias("_uri")).dropDuplicates(["_prefix"])
    joined = rows.withColumn("_p", qualified(name, lambda p: F.lit(None).cast("string"), default)["prefix"]).join(own, F.col("_p") == F.col("_prefix"), "left")
    return joined.withColumn(f"{column}_qname", qualified(name, lambda p: F.col("_uri"), default)).drop("_p", "_prefix", "_uri")


def attribute_name(name: Column) -> Column:
    """Attribute names without a prefix get the attribute namespace."""
    return F.when(prefix_of(name).isNull(), F.concat(F.lit(f"{ATTRIBUTE_PREFIX}:"), name)).otherwise(name)


_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"


def normal_datetime(text: Column) -> Column:
    """ISO seconds without a trailing Z where the text can be read as a time, else the text."""
    bare = F.regexp_replace(text, "Z$", "")
    return F.when(bare.rlike(_ISO), bare).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(bare), "yyyy-MM-dd'T'HH:mm:ss"), text))
