"""Sources, sinks and templates on small fixtures, by value."""

import json

import pytest
from pyspark.sql import functions as F

from provgraph.document import ProvenanceDocument
from provgraph.errors import TemplateError
from provgraph.functions.names import normal_datetime, resolve
from provgraph.operators import merge, templates
from provgraph.sinks import export
from provgraph.sources import formats, jsonld, records, template

MINIMAL = {"bundleName": "lab:empty", "mainActivity": {"id": "lab:idle"}}


@pytest.fixture(scope="module")
def full():
    """A titration: water and a reagent come in, a result and waste go out; one usage points at nothing."""
    b = template.TemplateBuilder("lab:run42", {"lab": "http://lab.example/", "chem": "http://chem.example/"})
    b.with_main_activity("lab:titration", startTime="2021-06-03T08:15:00Z", endTime="2021-06-03T11:40:00Z", referencedMetaBundleId="lab:notebook", hasPart=["lab:rinse", "lab:measure"], attributes={"chem:method": "EDTA"})
    b.with_backward_connector("lab:waterIn", externalId="field:77", referencedBundleId="field:trip9", referencedBundleHashValue="5f1d", hashAlg="SHA-512", attributedTo={"agentId": "lab:courier", "id": "lab:handover"}, attributes={"chem:volume": "250 ml"})
    b.with_backward_connector("lab:reagentIn")
    b.with_forward_connector("lab:resultOut", derivedFrom=["lab:waterIn", "lab:reagentIn"], specializedBy=["lab:reagentIn"], attributedTo="lab:registry")
    b.with_forward_connector("lab:wasteOut", derivedFrom=["lab:reagentIn"], specializationOf="lab:resultOut")
    b.with_sender_agent("lab:courier", contactIdPid="phone:112", attributes={"lab:vehicle": "van"}).with_receiver_agent("lab:registry").with_current_agent("lab:analyst")
    b.with_identifier_entity("lab:barcode", externalIdType="EAN").with_usage("lab:waterIn", "lab:use1").with_usage("lab:missing").with_usage("lab:reagentIn")
    return b.with_generation("lab:resultOut").with_generation("lab:wasteOut")


def census(g):
    n = {r.kind: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    return n, {r.relation: r["count"] for r in g.edges.groupBy("relation").count().collect()}


def test_template_to_graph(spark, full):
    g = templates.template_graph(full.build(spark))
    assert census(g) == ({"activity": 1, "entity": 5, "agent": 3}, {"usage": 2, "generation": 2, "attribution": 2, "derivation": 3, "specialization": 2})
    value = {(r.record_id, r.name, r.value) for r in g.attrs.collect()}
    assert value >= {("lab:titration", "dct:hasPart", "lab:rinse"), ("lab:titration", "dct:hasPart", "lab:measure"), ("lab:waterIn", "cpm:hashAlg", "SHA-512"), ("lab:titration", "chem:method", "EDTA")}
    assert {r.edge_id for r in g.edges.collect()} >= {"lab:use1", "lab:handover"}
    errors = {r.node_id for r in ProvenanceDocument(g).validate_structure().filter("bucket = 'errors'").collect()}
    assert errors == {"lab:reagentIn", "lab:resultOut", "lab:wasteOut"}  # none of them refers to a bundle
    assert census(templates.template_graph(template.templates_of(spark, MINIMAL))) == ({"activity": 1}, {})


def test_agents_in_several_lists(spark):
    t = template.templates_of(spark, MINIMAL | {"senderAgents": [{"id": "a", "attributes": {"x": "1", "y": "2"}}], "receiverAgents": [{"id": "a", "attributes": {"y": "3", "z": "4"}}, {"id": "b"}]})
    merged = templates.template_graph(t).nodes.filter("node_id = 'a'").collect()
    assert len(merged) == 1 and sorted(x.local for x in merged[0].types) == ["ReceiverAgent", "SenderAgent"]
    assert templates.template_graph(t, merge_agents=False).nodes.filter("node_id = 'a'").count() == 2
    row = templates.agent_overlap(t).first()
    assert (row.total_senders, row.total_receivers, row.overlapping_ids, row.merge_recommended) == (1, 2, ["a"], True)
    d = row.overlap_details[0]
    assert (d.sender_attributes, d.receiver_attributes, d.total_attributes, d.conflicts) == (2, 2, 3, 1)


def test_template_checks_and_quality(spark, full):
    bad = template.templates_of(spark, {"bundleName": "b", "mainActivity": {}, "currentAgents": [{"contactIdPid": "p"}]}, {"mainActivity": {"id": "m"}})
    assert sorted(r.problem for r in templates.template_findings(bad).collect()) == ["bundleName", "currentAgents[0].id", "mainActivity.id"]
    with pytest.raises(TemplateError):
        templates.check_templates(bad)
    with pytest.raises(TemplateError):
        template.TemplateBuilder("b").with_usage("x")
    q = templates.template_quality(templates.check_templates(full.build(spark))).first()
    assert (q.quality_score, q.quality_level, q.usage_relations, q.total_elements, q.connector_ratio, q.attribute_density) == (5, "Outstanding", 3, 17, 2.0, 0.25)
    assert templates.template_quality(template.templates_of(spark, MINIMAL)).first().quality_level == "Poor"


def test_template_round_trip(spark, full, tmp_path):
    t = full.build(spark)
    text = export.template_json(t).first().value
    assert json.loads(text)["mainActivity"]["used"][0] == {"targetId": "lab:waterIn", "relationId": "lab:use1"}
    assert set(json.loads(export.template_json(template.templates_of(spark, MINIMAL)).first().value)) == {"bundleName", "mainActivity"}
    assert template.templates_of(spark, text).collect() == t.collect()
    export.write_templates(t, str(tmp_path / "t"), check=True)
    assert template.read_templates(spark, str(tmp_path / "t")).collect() == t.collect()


def test_document_round_trips(spark, full):
    domain = ProvenanceDocument.empty(spark).add_node("entity", "lab:memo", {"chem:text": '5 < 6 & "so\\on"'}, "chem:Memo")
    g = ProvenanceDocument.from_template(full.build(spark), domain).graph
    out = export.export(g)
    assert out["provn"].startswith("document\n") and "used(lab:use1; lab:titration, lab:waterIn, -)" in out["provn"] and "bundle lab:run42" in out["provn"]
    for name in ("json", "xml"):
        back = formats.import_document(spark, out[name], name)
        assert merge.difference(g, back).count() == 0
        assert back.attrs.filter("record_id = 'lab:memo' AND name = 'chem:text'").first().value == '5 < 6 & "so\\on"'
        assert back.nodes.filter("node_id = 'lab:titration'").first().types[0].uri.endswith("/cpm/MainActivity")
    rdf = formats.import_document(spark, out["rdf"], "rdf")
    assert census(rdf)[0] == census(g)[0] and census(rdf)[1]["usage"] == 2
    assert "Error" in export.export(g, ("nonsense",))["nonsense"]
    with pytest.raises(ValueError):
        formats.import_document(spark, "", "nonsense")


def test_prov_json_details(spark):
    text = json.dumps({"prefix": {"ex": "http://e/"}, "entity": {"ex:a": [{"prov:type": {"$": "ex:T", "type": "prov:QUALIFIED_NAME"}}, {"ex:k": ["1", "2"]}]}, "hadMember": {"_:1": {"prov:collection": "ex:a", "prov:entity": ["ex:b", "ex:c"]}}, "bundle": {"ex:bun": {"activity": {"ex:a": {}, "ex:x": {"prov:startTime": "2024-01-01T00:00:00"}}}}})
    g = formats.import_document(spark, text)
    node = {r.node_id: r for r in g.nodes.collect()}
    assert node["ex:a"].kind == "entity" and node["ex:x"].bundle_id == "ex:bun" and node["ex:x"].start_time.year == 2024
    assert node["ex:b"].is_placeholder and g.edges.count() == 2 and g.attrs.filter("name = 'ex:k'").count() == 2


def test_jsonld(spark):
    data = {
        "@context": [{"prov": "http://www.w3.org/ns/prov#"}, {"dcat": "http://www.w3.org/ns/dcat#"}], "@id": "x:bundle",
        "@graph": [
            {"@id": "x:act", "@type": ["Action", "prov:Activity"], "startTime": "2024-01-01", "prov:used": [{"@id": "x:e1"}, {"@id": "x:e1"}], "object": "x:e9", "prov:generated": {"@id": "x:e2"}, "prov:wasAssociatedWith": [{"@id": "x:s"}, "x:t"],
             "prov:qualifiedAssociation": [{"prov:agent": {"@id": "x:s"}, "dcat:hadRole": "providing agent"}, {"prov:agent": {"@id": "x:r"}, "dcat:hadRole": "Receiving agent"}]},
            {"@id": "x:e1", "@type": "prov:Entity", "prov:wasDerivedFrom": {"@id": "x:src"}}, {"@id": "x:e2", "@type": ["Thing", "prov:Entity"]}, {"@id": "x:p", "@type": "Person"},
        ],
    }
    t = jsonld.jsonld_templates(formats.texts_of(spark, json.dumps(data), json.dumps({"@graph": [{"@id": "x:u", "@type": "Entity", "used": "y"}, {"@id": "x:g", "@type": "Entity", "generated": "y"}]}))).orderBy(F.desc("bundleName")).collect()
    a, b = t
    assert a.mainActivity.id == "x:act" and a.mainActivity.startTime == "2024-01-01" and [u.targetId for u in a.mainActivity.used] == ["x:e1", "x:e9"] and a.mainActivity.generated == ["x:e2"]
    assert [(c.id, c.derivedFrom) for c in a.backwardConnectors] == [("x:e1", ["x:src"]), ("x:e9", None)] and [c.id for c in a.forwardConnectors] == ["x:e2"]
    assert [x.id for x in a.senderAgents] == ["x:s", "x:t"] and [x.id for x in a.receiverAgents] == ["x:r"] and set(a.prefixes) == {"prov", "dcat"}
    assert b.bundleName == "embrc:bundle" and [c.id for c in b.backwardConnectors] == ["x:u"] and [c.id for c in b.forwardConnectors] == ["x:g"]
    kinds = {r.category: r["count"] for r in jsonld.categories(jsonld.nodes_of(formats.texts_of(spark, json.dumps(data)))).groupBy("category").count().collect()}
    assert kinds == {"persons": 1, "activities": 1, "other": 2}
    counts = jsonld.bundle_counts(jsonld.storage_bundles(formats.texts_of(spark, json.dumps(data)))).first()
    assert (counts.ti_nodes, counts.ds_nodes, counts.n_edges) == (4, 0, 3)


PATIENT = """<patient xmlns="http://www.bbmri.cz/schemas/biobank/data" biobank="HTO" consent="false" id="a17" month="--05" sex="male" year="1964"><LTS>
<tissue number="12" sampleId="S:9" year="2019"><samplesNo>6</samplesNo><availableSamplesNo>4</availableSamplesNo><materialType>gC</materialType><pTNM>T1N0</pTNM><morphology>8070/3</morphology><diagnosis>J340</diagnosis><cutTime>2019-02-14T07:05:00</cutTime><freezeTime>later</freezeTime></tissue></LTS>
<STS><diagnosisMaterial number="13" sampleId="S:10" year="2019"><materialType>PK</materialType><takingDate>2019-03-01T16:45:00</takingDate></diagnosisMaterial><diagnosisMaterial number="14" sampleId="S:11" year="2020"/><diagnosisMaterial sampleId="S:12"><diagnosis>K2</diagnosis></diagnosisMaterial></STS></patient>"""


def test_patient_files(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PATIENT)
    s = records.read_patient_samples(spark, str(tmp_path / "p.xml"))
    rows = {r.sample_id: r for r in s.collect()}
    assert set(rows) == {"S:9", "S:10", "S:11", "S:12"} and rows["S:9"].samples_no == 6 and rows["S:11"].material_type == "" and rows["S:12"].number == "" and rows["S:10"].taking_date.hour == 16
    assert rows["S:9"].cut_time.day == 14 and rows["S:9"].freeze_time is None and rows["S:9"].consent is False and rows["S:12"].taking_date is None
    acquired, stored = records.acquisition_graph(s), records.storage_graph(s)
    assert acquired.bundles.count() == stored.bundles.count() == 4
    assert census(acquired) == ({"activity": 8, "entity": 12, "agent": 4}, {"generation": 8, "specialization": 8, "attribution": 4})
    assert stored.edges.count() == 44 and stored.nodes.count() == 36
    loose = ProvenanceDocument(stored)
    assert loose.get_nodes_by_type("MainActivity").count() == 4 and loose.get_main_activity() is None  # another namespace than the exact test asks for


def test_biobank_tables(spark):
    """Two samples of a patient, one of them stored; a third of a patient nobody knows."""
    p = spark.createDataFrame([("q1", "male", 1964, False)], "patient_id string, sex string, birth_year int, gave_consent boolean")
    rows = [("S:1", "q1", "gC", "LTS", "J340", "HOSP"), ("S:2", "q1", "PK", "STS", "J341", "HOSP"), ("S:3", "q9", "PK", "STS", "K2", "HOSP")]
    s = spark.createDataFrame(rows, "sample_id string, patient_id string, material_type string, storage_type string, diagnosis string, hospital_id string").withColumn("taking_date", F.lit("2019-02-14 07:05:00").cast("timestamp"))
    st = spark.createDataFrame([("k", "S:1", "Shelf", "me")], "storage_id string, sample_id string, storage_location string, operator_id string").withColumn("stored_at", F.lit("2019-02-15 09:00:00").cast("timestamp"))
    g = records.biobank_graph(p, s, st)
    assert (g.nodes.count(), g.edges.count()) == (9 + 9 + 8, 11 + 11 + 9)
    assert [r.start_time.day for r in g.nodes.filter("start_time IS NOT NULL").collect()] == [15]
    assert {r.value for r in g.attrs.filter("name = 'bbmri:takingDate'").collect()} == {"2019-02-14T07:05:00Z"}


def test_names_and_times(spark):
    names = spark.createDataFrame([("ex:a",), ("odd:b",), ("c",), ("cpm:D",), ("http://x/y#z",)], "n string")
    got = {r.n: r.n_qname for r in resolve(names, "n", spark.createDataFrame([("ex", "http://e/")], "prefix string, uri string")).collect()}
    assert [got[n].uri for n in ("ex:a", "odd:b", "c", "http://x/y#z")] == ["http://e/a", "http://example.org/odd/b", "http://example.org/default/c", "http://x/y#z"]
    assert got["cpm:D"].uri.endswith("/ns/cpm/D") and got["http://x/y#z"].local == "z"
    times = [("2024-01-01T00:00:00Z", "2024-01-01T00:00:00"), ("2024-01-01", "2024-01-01T00:00:00"), ("soon", "soon"), (None, None)]
    rows = spark.createDataFrame(times, "t string, want string").withColumn("got", normal_datetime(F.col("t"))).collect()
    assert all(r.got == r.want for r in rows)


def test_graph_tables_round_trip(spark, full, tmp_path):
    g = templates.template_graph(full.build(spark))
    export.write_graph(g, str(tmp_path / "g"))
    edges = spark.read.parquet(str(tmp_path / "g/edges"))
    assert edges.filter("relation = 'usage'").count() == 2 and export.dot_lines(g).count() == 20


def test_jsonld_templates_shuffle_nothing_and_pair_no_documents(spark):
    """Two documents under one name stay two templates; an opened bundle's nodes come by their place; the plan has no exchange."""
    docs = [
        ("same", {"@id": "x:one", "@graph": [{"@id": "x:e", "@type": "Entity", "prov:wasDerivedFrom": [{"@id": "x:d"}]}, {"@id": "x:a1", "@type": "Activity", "used": ["x:e", "x:f"]}]}),
        ("same", {"@id": "x:one", "@context": [{"p": "q"}], "@graph": [{"@id": "x:in", "@type": "Bundle", "@graph": [{"@id": "x:a2", "@type": ["Activity"]}]}, {"@id": "x:a3", "@type": "Activity"}]}),
        ("none", {"@id": "x:none"}),
    ]
    texts = spark.createDataFrame([(d, json.dumps(v)) for d, v in docs], "doc string, value string")
    t = jsonld.jsonld_templates(texts)
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    rows = templates.full_pipeline(texts, "embrc").collect()
    assert sorted((r.bundleName, r.mainActivity.id, [(b.id, b.derivedFrom) for b in r.backwardConnectors], r.prefixes, r.quality.backward_connectors) for r in rows) == [
        ("x:none", "embrc:mainActivity", [], {}, 0), ("x:one", "x:a1", [("x:e", ["x:d"]), ("x:f", None)], {}, 2), ("x:one", "x:a2", [], {"p": "q"}, 0),
    ]
