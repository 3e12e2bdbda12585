"""Bundle templates: one nested row per bundle, read from JSON, built in Python, or made of columns."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TemplateError

_MAP = "map<string, string>"
_TARGET = "struct<targetId: string, relationId: string>"
_AGENT = f"struct<id: string, contactIdPid: string, attributes: {_MAP}>"
_CONNECTOR = (
    f"struct<id: string, externalId: string, attributedTo: {_TARGET}, referencedBundleId: string, referencedMetaBundleId: string, referencedBundleHashValue: string, hashAlg: string, "
    f"provenanceServiceUri: string, derivedFrom: array<string>, specializedBy: array<string>, specializationOf: string, attributes: {_MAP}>"
)
TEMPLATE = (
    f"bundleName string, prefixes {_MAP}, mainActivity struct<id: string, startTime: string, endTime: string, referencedMetaBundleId: string, used: array<{_TARGET}>, generated: array<string>, hasPart: array<string>, attributes: {_MAP}>, "
    f"backwardConnectors array<{_CONNECTOR}>, forwardConnectors array<{_CONNECTOR}>, senderAgents array<{_AGENT}>, receiverAgents array<{_AGENT}>, currentAgents array<{_AGENT}>, "
    f"identifierEntities array<struct<id: string, externalId: string, externalIdType: string, comment: string, attributes: {_MAP}>>"
)
LISTS = ("backwardConnectors", "forwardConnectors", "senderAgents", "receiverAgents", "currentAgents", "identifierEntities")
#: As in TEMPLATE, but relation objects are kept as text, as they may be strings or objects with other keys.
_RAW = TEMPLATE.replace(f"array<{_TARGET}>", "array<string>").replace(_TARGET, "string")


def _target(raw: Column) -> Column:
    """A relation given as an id or as an object with any of its key spellings."""
    keys = F.from_json(raw, "map<string, string>")
    return F.when(raw.isNull(), F.lit(None)).when(
        raw.startswith("{"), F.named_struct(F.lit("targetId"), F.coalesce(keys["targetId"], keys["bcId"], keys["agentId"], F.lit("")), F.lit("relationId"), F.coalesce(keys["relationId"], keys["id"]))
    ).otherwise(F.named_struct(F.lit("targetId"), raw, F.lit("relationId"), F.lit(None).cast("string")))


def _normal(raw: DataFrame) -> DataFrame:
    main = F.col("mainActivity")
    main = F.when(main.isNotNull(), main.withField("used", F.transform(main["used"], _target)))

    def connectors(name: str) -> Column:
        return F.transform(name, lambda c: c.withField("attributedTo", _target(c["attributedTo"]))).alias(name)

    out = raw.select("bundleName", F.coalesce("prefixes", F.create_map().cast(_MAP)).alias("prefixes"), main.alias("mainActivity"), connectors("backwardConnectors"), connectors("forwardConnectors"), *LISTS[2:])
    schema = T.StructType.fromDDL(TEMPLATE)
    return out.select(*[(F.coalesce(F.col(f.name), F.array().cast(f.dataType)) if f.name in LISTS else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates from JSON files (one object per file, or an array of them) below a path or glob."""
    return _normal(spark.read.schema(_RAW).json(path, multiLine=True))


def parse_templates(rows: DataFrame, column: str = "value") -> DataFrame:
    """Templates from a column of JSON text."""
    return _normal(rows.select(F.from_json(column, _RAW).alias("t")).select("t.*"))


def _fitted(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` as ``want``: fields that a struct lacks are null, inside arrays too."""
    if isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have}
        fields = [(_fitted(c[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and have != want:
        return F.transform(c, lambda x: _fitted(x, have.elementType, want.elementType))
    return c.cast(want)


def templates_from(rows: DataFrame) -> DataFrame:
    """Templates from columns named like those of TEMPLATE; columns and fields may lack, lists then are empty."""
    have = {f.name: f.dataType for f in rows.schema}
    out = []
    for f in T.StructType.fromDDL(TEMPLATE):
        c = _fitted(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.array().cast(f.dataType)) if f.name in LISTS else F.coalesce(c, F.create_map().cast(_MAP)) if f.name == "prefixes" else c).alias(f.name))
    return rows.select(*out)


def templates_of(spark: SparkSession, *data: Mapping[str, Any] | str) -> DataFrame:
    """Templates from dicts or JSON strings on the driver."""
    texts = [d if isinstance(d, str) else json.dumps(d, ensure_ascii=False) for d in data]
    return parse_templates(spark.createDataFrame([(t,) for t in texts], "value string"))


class TemplateBuilder:
    """Collects a template step by step; ``build`` gives a row, ``to_dict`` its plain form."""

    def __init__(self, bundle_name: str, prefixes: Mapping[str, str] | None = None):
        self.data: dict[str, Any] = {"bundleName": bundle_name, "prefixes": dict(prefixes or {})}

    def _item(self, where: str, item_id: str, options: Mapping[str, Any]) -> TemplateBuilder:
        self.data.setdefault(where, []).append({"id": item_id, **{k: v for k, v in options.items() if v}})
        return self

    def _main(self) -> dict[str, Any]:
        if "mainActivity" not in self.data:
            raise TemplateError("the template has no main activity yet")
        return self.data["mainActivity"]

    def with_prefix(self, prefix: str, uri: str) -> TemplateBuilder:
        self.data["prefixes"][prefix] = uri
        return self

    def with_main_activity(self, activity_id: str, **options: Any) -> TemplateBuilder:
        """Options by their JSON names: startTime, endTime, referencedMetaBundleId, attributes."""
        self.data["mainActivity"] = {"id": activity_id, **{k: v for k, v in options.items() if v}}
        return self

    def with_backward_connector(self, connector_id: str, **options: Any) -> TemplateBuilder:
        return self._item("backwardConnectors", connector_id, options)

    def with_forward_connector(self, connector_id: str, **options: Any) -> TemplateBuilder:
        return self._item("forwardConnectors", connector_id, options)

    def with_sender_agent(self, agent_id: str, **options: Any) -> TemplateBuilder:
        return self._item("senderAgents", agent_id, options)

    def with_receiver_agent(self, agent_id: str, **options: Any) -> TemplateBuilder:
        return self._item("receiverAgents", agent_id, options)

    def with_current_agent(self, agent_id: str, **options: Any) -> TemplateBuilder:
        return self._item("currentAgents", agent_id, options)

    def with_identifier_entity(self, entity_id: str, **options: Any) -> TemplateBuilder:
        return self._item("identifierEntities", entity_id, options)

    def with_usage(self, entity_id: str, relation_id: str | None = None) -> TemplateBuilder:
        self._main().setdefault("used", []).append({"targetId": entity_id, **({"relationId": relation_id} if relation_id else {})})
        return self

    def with_generation(self, entity_id: str) -> TemplateBuilder:
        self._main().setdefault("generated", []).append(entity_id)
        return self

    def with_part(self, part_id: str) -> TemplateBuilder:
        self._main().setdefault("hasPart", []).append(part_id)
        return self

    def to_dict(self) -> dict[str, Any]:
        self._main()
        return self.data

    def build(self, spark: SparkSession) -> DataFrame:
        return templates_of(spark, self.to_dict())
