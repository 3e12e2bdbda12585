"""Graphs from plain records: triples, biobank tables, patient XML."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normal_datetime
from ..graph import ProvGraph
from .build import all_of, attr_rows, edge_rows, graph_from, node_rows

# Namespaces of the biobank bundles, and the hospital that sends samples in patient files.
BIOBANK_PREFIXES = {
    "bbmri": "http://www.bbmri.cz/schemas/biobank/data#", "cpm": "https://www.commonprovenancemodel.org/cpm-namespace-v1-0/", "pbm": "http://commonprovenancemodel.org/ns/pbm/", "dct": "http://purl.org/dc/terms/",
}


def simple_graph(spark: SparkSession, entities: Iterable[str] | DataFrame, activities: Iterable[tuple[str, str, str]] | DataFrame) -> ProvGraph:
    """Entities, and (activity, source, target) triples: the activity uses the source and generates the target.

    A triple with an end that is no entity is left out.
    """
    ents = entities if isinstance(entities, DataFrame) else spark.createDataFrame([(e,) for e in entities], "id string")
    acts = activities if isinstance(activities, DataFrame) else spark.createDataFrame(list(activities), "activity string, source string, target string")
    known = ents.select("id").distinct()
    for end in ("source", "target"):
        acts = acts.join(known, F.col(end) == F.col("id"), "left_semi")
    none = F.lit(None).cast("string")
    nodes = all_of(node_rows(known, none, F.col("id"), "entity"), node_rows(acts.select("activity").distinct(), none, F.col("activity"), "activity"))
    pairs = acts.select(F.explode(F.array(
        F.named_struct(F.lit("relation"), F.lit("usage"), F.lit("arg1"), F.col("activity"), F.lit("arg2"), F.col("source")),
        F.named_struct(F.lit("relation"), F.lit("generation"), F.lit("arg1"), F.col("target"), F.lit("arg2"), F.col("activity")),
    )).alias("e")).select("e.*")
    edges = pairs.select(none.alias("bundle_id"), F.concat_ws("|", "relation", "arg1", "arg2").alias("edge_id"), "relation", "arg1", "arg2", F.lit(0).cast("long").alias("ordinal"))
    return graph_from(spark, nodes, edges)


def _name(local: str, *parts: str) -> Column:
    """``bbmri:local-a-b`` with the colons of the parts made safe."""
    return F.concat(F.lit(f"bbmri:{local}-"), F.concat_ws("-", *[F.replace(F.col(p).cast("string"), F.lit(":"), F.lit("-")) for p in parts]))


def biobank_graph(patients: DataFrame, samples: DataFrame, storage: DataFrame) -> ProvGraph:
    """One storage bundle per sample, with its first patient and storage record.

    The patient of a sample may be missing; its entity and derivations then are. A storage record
    adds its place and time to the storage activity.
    """
    one = patients.groupBy("patient_id").agg(*[F.min(c).alias(c) for c in ("sex", "birth_year", "gave_consent")]).withColumnRenamed("patient_id", "known_patient")
    kept = storage.groupBy(F.col("sample_id").alias("stored_sample")).agg(F.min_by(F.struct("storage_location", "stored_at", "operator_id"), F.struct("stored_at", "storage_id")).alias("kept"))
    s = samples.join(one, F.col("patient_id") == F.col("known_patient"), "left").join(kept, F.col("sample_id") == F.col("stored_sample"), "left")
    return _storage_bundles(s.withColumn("stored_at", F.col("kept.stored_at")))


def _storage_bundles(s: DataFrame) -> ProvGraph:
    """A bundle per row: transport and storage of a sample, between its two connectors."""
    k = ("patient_id", "sample_id")
    bundle = _name("storageBundle", *k)
    main, back, front = _name("storage", *k), _name("sampleAcqConnector", *k), _name("sampleStorConnector", *k)
    sender, transport, sample = F.concat(F.lit("bbmri:"), F.col("hospital_id")), _name("transport", *k), _name("sampleTrans", *k)
    act, stored, patient = _name("storageAct", *k), _name("sampleStorage", *k), _name("patient", "patient_id")
    with_patient = s.filter("known_patient IS NOT NULL")
    nodes = all_of(
        node_rows(s, bundle, main, "activity", "cpm:mainActivity"), node_rows(s, bundle, back, "entity", "cpm:backwardConnector"), node_rows(s, bundle, front, "entity", "cpm:forwardConnector"), node_rows(s, bundle, sender, "agent", "cpm:senderAgent"),
        node_rows(s, bundle, transport, "activity", "pbm:transportActivity"), node_rows(s, bundle, sample, "entity", "pbm:sample"), node_rows(s, bundle, act, "activity", "pbm:storageActivity", start=F.col("stored_at")),
        node_rows(s, bundle, stored, "entity", "bbmri:diagnosticMaterial"), node_rows(with_patient, bundle, patient, "entity", "pbm:source"),
    )
    edges = all_of(
        edge_rows(s, bundle, "usage", main, back), edge_rows(s, bundle, "generation", front, main), edge_rows(s, bundle, "attribution", back, sender), edge_rows(s, bundle, "derivation", front, back),
        edge_rows(s, bundle, "generation", sample, transport), edge_rows(s, bundle, "specialization", sample, back), edge_rows(s, bundle, "usage", act, sample), edge_rows(s, bundle, "generation", stored, act),
        edge_rows(s, bundle, "specialization", stored, front), edge_rows(with_patient, bundle, "derivation", sample, patient), edge_rows(with_patient, bundle, "derivation", stored, patient),
    )
    attrs = all_of(
        attr_rows(s, main, dct__hasPart=transport), attr_rows(s, back, cpm__referencedBundleId=_name("acquisitionBundle", *k)), attr_rows(s, sample, bbmri__sampleId="sample_id"),
        attr_rows(s, stored, bbmri__sampleId="sample_id", bbmri__storageType="storage_type", bbmri__materialType="material_type", bbmri__diagnosis="diagnosis", bbmri__takingDate=F.date_format("taking_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        attr_rows(with_patient, patient, bbmri__sex="sex", bbmri__birthYear=F.col("birth_year").cast("string"), bbmri__gaveConsent=F.lower(F.col("gave_consent").cast("string"))),
    )
    return _per_bundle(s, nodes, edges, attrs)


HOSPITAL = "UNI"
_PATIENT = "_id string, _biobank string, _consent boolean, _month string, _sex string, _year int"
_TISSUE = "_sampleId string, _number string, _year string, samplesNo int, availableSamplesNo int, materialType string, pTNM string, morphology string, diagnosis string, cutTime string, freezeTime string, retrieved string"
_MATERIAL = "_sampleId string, _number string, _year string, materialType string, diagnosis string, takingDate string, retrieved string"
_FILE = f"{_PATIENT}, LTS struct<tissue: array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in _TISSUE.split(', '))}>>>, STS struct<diagnosisMaterial: array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in _MATERIAL.split(', '))}>>>"


def read_patient_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of patient XML files: the patient's columns, storage LTS or STS, the sample's columns.

    Missing numbers are 0 and missing texts empty, as in the files' own conventions.
    """
    p = spark.read.schema(_FILE).option("rowTag", "patient").option("ignoreNamespace", "true").xml(path)
    who = [F.coalesce("_id", F.lit("")).alias("patient_id"), F.coalesce("_biobank", F.lit("")).alias("biobank"), F.coalesce("_consent", F.lit(False)).alias("consent"), F.coalesce("_month", F.lit("")).alias("month"), F.coalesce("_sex", F.lit("")).alias("sex"), F.coalesce("_year", F.lit(0)).alias("birth_year")]
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    number = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0))
    time = lambda c: F.try_to_timestamp(normal_datetime(F.col(f"x.{c}")))
    none = lambda t: F.lit(None).cast(t)
    both = [text("_sampleId").alias("sample_id"), text("_number").alias("number"), text("_year").alias("year"), text("materialType").alias("material_type"), text("diagnosis").alias("diagnosis"), text("retrieved").alias("retrieved")]
    lts = p.select(*who, F.posexplode("LTS.tissue").alias("place", "x")).select("patient_id", "biobank", "consent", "month", "sex", "birth_year", F.lit("LTS").alias("storage"), "place", *both, number("samplesNo").alias("samples_no"), number("availableSamplesNo").alias("available_samples_no"), text("pTNM").alias("ptnm"), text("morphology").alias("morphology"), time("cutTime").alias("cut_time"), time("freezeTime").alias("freeze_time"), none("timestamp").alias("taking_date"))
    sts = p.select(*who, F.posexplode("STS.diagnosisMaterial").alias("place", "x")).select("patient_id", "biobank", "consent", "month", "sex", "birth_year", F.lit("STS").alias("storage"), "place", *both, none("int").alias("samples_no"), none("int").alias("available_samples_no"), none("string").alias("ptnm"), none("string").alias("morphology"), none("timestamp").alias("cut_time"), none("timestamp").alias("freeze_time"), time("takingDate").alias("taking_date"))
    return lts.unionByName(sts)


def acquisition_graph(s: DataFrame) -> ProvGraph:
    """One acquisition bundle per sample row of ``read_patient_samples``."""
    k = ("patient_id", "sample_id")
    bundle, main, front, spec = _name("acquisitionBundle", *k), _name("acquisition", *k), _name("sampleAcqConnector", *k), _name("sampleAcqConnectorSpec", *k)
    receiver, sample, act = F.concat(F.lit("bbmri:"), F.col("biobank")), _name("sample", *k), _name("acquisitionAct", *k)
    nodes = all_of(
        node_rows(s, bundle, main, "activity", "cpm:mainActivity"), node_rows(s, bundle, front, "entity", "cpm:forwardConnector"), node_rows(s, bundle, spec, "entity", "cpm:forwardConnector"),
        node_rows(s, bundle, receiver, "agent", "cpm:receiverAgent"), node_rows(s, bundle, sample, "entity", "pbm:sample"), node_rows(s, bundle, act, "activity", "pbm:acquisitionActivity"),
    )
    edges = all_of(edge_rows(s, bundle, "generation", front, main), edge_rows(s, bundle, "specialization", spec, front), edge_rows(s, bundle, "attribution", spec, receiver), edge_rows(s, bundle, "specialization", sample, front), edge_rows(s, bundle, "generation", sample, act))
    attrs = all_of(attr_rows(s, main, dct__hasPart=act), attr_rows(s, spec, cpm__referencedBundleId=_name("storageBundle", *k)), attr_rows(s, sample, bbmri__sampleId="sample_id"))
    return _per_bundle(s, nodes, edges, attrs)


def _per_bundle(s: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> ProvGraph:
    """Records of each bundle; an agent that several bundles declare is a record in each of them."""
    return graph_from(s.sparkSession, nodes.distinct(), edges, attrs.distinct(), BIOBANK_PREFIXES)


def storage_graph(s: DataFrame, hospital: str = HOSPITAL) -> ProvGraph:
    """One storage bundle per sample row of ``read_patient_samples``."""
    return _storage_bundles(s.withColumns({
        "hospital_id": F.lit(hospital), "storage_type": F.col("storage"), "known_patient": F.col("patient_id"), "gave_consent": F.col("consent"), "taking_date": F.lit(None).cast("timestamp"), "stored_at": F.lit(None).cast("timestamp"),
    }))
