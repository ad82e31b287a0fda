import json

import pytest
from bundle_data import OBJECTS

from graphloom.operators import traverse
from graphloom.sources import bundle


@pytest.fixture(scope="module")
def objects(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bundle") / "bundle.json"
    path.write_text(json.dumps({"type": "bundle", "objects": OBJECTS}, indent=1))
    return bundle.read_bundle(spark, str(path)).cache()


@pytest.fixture(scope="module")
def graph(objects):
    nodes = bundle.parse_nodes(objects).cache()
    return nodes, bundle.edges(nodes, bundle.parse_relationships(objects)).cache()


def test_parsing(graph):
    nodes = {r.id: r for r in graph[0].collect()}
    assert len(nodes) == 16 and "attack-pattern--3" not in nodes and "attack-pattern--4" not in nodes
    assert nodes["attack-pattern--2"].external_id == "X-9" and nodes["attack-pattern--2"].url.endswith("T1078.002")
    assert nodes["attack-pattern--2"].is_subtechnique and not nodes["attack-pattern--1"].is_subtechnique
    assert nodes["attack-pattern--2"].platforms == [] and nodes["tool--2"].aliases == []
    assert nodes["x-mitre-analytic--1"].data_component_refs == ["x-mitre-data-component--1"]
    assert nodes["x-mitre-detection-strategy--1"].description is None
    assert json.loads(nodes["x-mitre-data-component--1"].log_sources) == [{"name": "wineventlog"}]
    assert nodes["campaign--1"].first_seen == "2021-01-01T00:00:00Z" and nodes["intrusion-set--1"].platforms is None


def test_tables_and_sinks(objects, spark, tmp_path):
    tables = bundle.tables(objects)
    assert len(tables) == 11 and tables["relationships"].count() == 16
    for form in ("parquet", "json"):
        report = bundle.write_tables({k: tables[k] for k in ("tactics", "tools")}, str(tmp_path / form), form)
        assert {r.table: r.rows for r in report.collect()} == {"tactics": 2, "tools": 2}
    back = bundle.read_table(spark, str(tmp_path / "json" / "tactics"), tables["tactics"].schema)
    assert {r.shortname for r in back.collect()} == {"initial-access", "exfiltration"}


def test_edges(objects, graph):
    found = {tuple(r) for r in graph[1].collect()}
    assert ("intrusion-set--1", "USES", "attack-pattern--1") in found
    assert ("attack-pattern--1", "BELONGS_TO_TACTIC", "x-mitre-tactic--1") in found
    assert ("x-mitre-detection-strategy--1", "HAS_ANALYTIC", "x-mitre-analytic--2") in found
    assert ("x-mitre-analytic--1", "USES_DATA_COMPONENT", "x-mitre-data-component--1") in found
    assert not any("--9" in s + d or "attack-pattern--3" in d or s.startswith("x-mitre-tactic") for s, _, d in found)
    report = {r.rel: (r.attempted, r.written) for r in bundle.edge_report(graph[0], bundle.parse_relationships(objects)).collect()}
    assert report["HAS_ANALYTIC"] == (3, 2) and report["USES"] == (10, 7)


def test_traverse(spark, graph):
    nodes, edges = graph
    ids = [(i, r.id, r.node_type) for i, r in enumerate(nodes.orderBy("id").collect())]
    hits = spark.createDataFrame([(0, i, a, t, 0.5) for i, a, t in ids] + [(0, 99, "gone", "Tool", 0.1), (0, 98, "tool--1", "Actor", 0.1)], "query_id int, pos int, id string, node_type string, rrf_score double")
    rows = {r.node_id: r for r in traverse.traverse(hits, nodes, edges).collect()}
    assert len(rows) == len(ids)
    t = rows["attack-pattern--1"]
    assert t.tactics == ["Initial Access"] and t.actors == ["Velvet Bear"] and t.malware == ["Gloomware"] and t.tools == []
    assert t.analytics == ["Looks at logons"] and t.log_source_names == ["Logon Events"] and t.detections == ["Watch Logons"]
    assert t.subtechniques == ["Domain Accounts"] and t.mitigations == ["Rotate Keys"] and t.campaigns == ["Silent Harbour"]
    # the strategy lists an analytic without a data component, which the technique does not
    assert rows["x-mitre-detection-strategy--1"].analytics == ["Looks at logons", "Looks at nothing"]
    assert rows["attack-pattern--2"].parent_technique == "Accounts"
    assert rows["intrusion-set--1"].tools == ["Doorpick"] and rows["intrusion-set--1"].tactics == ["Initial Access"]
    assert rows["malware--1"].mitigations == ["Rotate Keys"] and rows["course-of-action--1"].actors == ["Velvet Bear"]
    assert rows["x-mitre-tactic--1"].techniques == ["Domain Accounts", "Valid Accounts"] and rows["x-mitre-tactic--2"].techniques == []
    assert rows["campaign--1"].actors == ["Velvet Bear"] and rows["x-mitre-analytic--1"].techniques == ["Valid Accounts"]
    d = rows["x-mitre-data-component--1"]
    assert d.analytics == ["Analytic 1"] and d.detection_strategies == ["Watch Logons"] and d.techniques == ["Valid Accounts"]
    assert rows["intrusion-set--1"].external_id == "G0001" and rows["intrusion-set--1"].aliases and rows["tool--1"].shortname is None


def test_upsert(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    change = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 1), ("b", None, 1)], "id string, n int, at int")
    once = bundle.upsert(now, change, ["id"], ["at"])
    assert sorted(tuple(r) for r in once.collect()) == [("a", 6, "x"), ("b", None, "y"), ("c", 7, None)]
    assert sorted(tuple(r) for r in bundle.upsert(once, change, ["id"], ["at"]).collect()) == sorted(tuple(r) for r in once.collect())
    assert bundle.broken_keys(change).first().n == 2
    with pytest.raises(ValueError, match="not unique"):
        bundle.require_unique(change)


def test_null_keys_match_nothing(spark):
    now = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "id string, n int, s string")
    change = spark.createDataFrame([(None, 5, 1), (None, 6, 2), ("a", 7, 1)], "id string, n int, at int")
    got = bundle.upsert(now, change, ["id"], ["at"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 7, "x"), (None, 2, "y"), (None, 5, None), (None, 6, None)], key=str)


def test_read_array(spark, tmp_path):
    (tmp_path / "t.json").write_text('[\n{"id": "1", "name": "a"},\n{"id": "2"}\n]')
    assert bundle.read_array(spark, str(tmp_path / "t.json"), bundle._struct(id=bundle.S, name=bundle.S)).count() == 2


def test_malformed_bundles(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"objects": [{"type": "tool", "id": "tool--1", "name": "x", "unknown": {"a": 1}}]}')
    assert [r.id for r in bundle.read_bundle(spark, str(tmp_path)).collect()] == ["tool--1"]
    (tmp_path / "bad.json").write_text('{"objects": [{"type": "tool", "id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        bundle.read_bundle(spark, str(tmp_path)).collect()
    assert [r.id for r in bundle.read_bundle(spark, str(tmp_path), "DROPMALFORMED").collect()] == ["tool--1"]


def test_settings():
    from graphloom.config import Settings

    assert Settings.from_env({}) == Settings()
    assert Settings.from_env({"GRAPHLOOM_TOP_K": "3", "GRAPHLOOM_FOLDER": "s3a://x"}) == Settings(folder="s3a://x", top_k=3)
    with pytest.raises(ValueError, match="invalid"):
        Settings.from_env({"GRAPHLOOM_SHOWN": "many"})
