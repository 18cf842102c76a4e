from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronofact.functions import identity
from chronofact.operators import graph, manifest, policy

ASSERTION = ("assertions array<struct<assertion_id:string,subject_id:string,predicate:string,object:string,"
             "valid_from:timestamp_ntz,valid_to:timestamp_ntz,event_time:timestamp_ntz>>")
RECORD = "record_id string, source_id string, known_at timestamp_ntz, commit_seq long, operation string, " + ASSERTION


def records(spark, predicate, obj):
    claim = ("assertion-1", "driver-1", predicate, obj, datetime(2026, 8, 1), None, None)
    return spark.createDataFrame([("record-1", "source-1", datetime(2026, 9, 1), 1, "assert", [claim])], RECORD)


def entities(spark):
    return spark.createDataFrame([("driver-1", "DRIVER", "An"), ("fleet-1", "FLEET", "Depot 1")], "entity_id string, entity_type string, name string")


def test_episode_names_entities_and_keeps_provenance(spark):
    rows = records(spark, "MEMBER_OF", '{"type":"entity_ref","value":"fleet-1"}')
    edges = graph.edges(rows, entities(spark))
    text = graph.episodes(rows, edges).first()["text"]
    for part in ('DRIVER "An" [id=driver-1]', "Quan hệ/vị từ: MEMBER_OF", 'FLEET "Depot 1" [id=fleet-1]', "2026-09-01T00:00:00.000000Z",
                 "[2026-08-01T00:00:00.000000Z, không giới hạn)", "source_id=source-1"):
        assert part in text
    line = graph.lineage(edges, graph.episodes(rows, edges)).first()
    assert (line["record_id"], line["assertion_id"]) == ("record-1", "assertion-1")


@pytest.mark.parametrize("predicate,obj,expected", [
    ("DRIVER_STATUS", '{"type":"enum","value":"active"}', "DRIVER_STATUS = active"),
    ("ARTIFACT_PUBLICATION", '{"type":"enum","value":"available"}', "ARTIFACT_PUBLICATION = available"),
    ("REPORTED_MEASURE", '{"type":"integer","value":300000}', "REPORTED_MEASURE = 300000"),
    ("REPORTED_MEASURE", '{"type":"rational","value":{"n":97,"d":20}}', "REPORTED_MEASURE = 97/20"),
    ("REPORTED_MEASURE", '{"type":"boolean","value":true}', "REPORTED_MEASURE = true")])
def test_literals_become_target_nodes(spark, predicate, obj, expected):
    rows = records(spark, predicate, obj)
    edges = graph.edges(rows, entities(spark))
    text = graph.episodes(rows, edges).first()["text"]
    assert "Bộ ba bắt buộc:" in text and expected in text and "[id=value:assertion-1" in text
    assert {r[0] for r in graph.nodes(edges).collect()} == {"driver-1", "value:assertion-1"}
    once = graph.upsert(edges.limit(0), edges, "edge_id")
    assert graph.upsert(once, edges, "edge_id").count() == 1


def test_every_record_has_an_episode_with_targets_and_sources(spark):
    kind = ("assertions array<struct<assertion_id:string,subject_id:string,predicate:string,object:string,qualifiers:map<string,string>,"
            "source_refs:array<struct<document_revision_id:string,clause_ids:array<string>>>>>")
    claim = ("a1", "driver-1", "STATUS", '{"type":"enum","value":"active"}', {"unit": "day", "by": "x"}, [("rev-1", ["c1", "c2"]), ("rev-2", [])])
    rows = spark.createDataFrame(
        [("r1", "s", datetime(2026, 9, 1), 1, "assert", None, [claim]), ("r2", "s", datetime(2026, 9, 2), 2, "retract", ["a1"], []),
         ("r3", "s", datetime(2026, 9, 3), 3, "retract", ["a1", "a2"], None)],
        "record_id string, source_id string, known_at timestamp_ntz, commit_seq long, operation string, target_assertion_ids array<string>, " + kind)
    got = {r["record_id"]: r for r in graph.episodes(rows, graph.edges(rows, entities(spark))).collect()}
    assert set(got) == {"r1", "r2", "r3"} and [got[r]["assertion_count"] for r in ("r1", "r2", "r3")] == [1, 0, 0]
    assert "qualifiers: by=x,unit=day; sources: rev-1[c1,c2],rev-2[]" in got["r1"]["text"]
    assert got["r3"]["text"].endswith("operation=retract targets=a1,a2")


def test_query_text_with_lists(spark):
    queries = spark.createDataFrame(
        [("q", "Tài xế thuộc depot nào?", ["fleet-1", "driver-1", "gone"], datetime(2026, 9, 1), ["snap-154", "snap-2"]), ("n", "?", None, None, None)],
        "query_id string, query string, entity_refs array<string>, known_as_of timestamp_ntz, snapshot_refs array<string>")
    got = {r["query_id"]: r["text"] for r in graph.query_text(queries, entities(spark)).collect()}
    assert got["q"].split("\n") == ["Tài xế thuộc depot nào?", 'FLEET "Depot 1" [id=fleet-1]', 'DRIVER "An" [id=driver-1]', 'ENTITY "gone" [id=gone]',
                                    "known_as_of=2026-09-01T00:00:00.000000Z", "snapshot=snap-154", "snapshot=snap-2"]
    assert got["n"] == "?"


def test_resume_needs_an_exact_prefix(spark):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "position int, name string")

    expected = rows((1, "a"), (2, "b"), (3, "c"))
    problems = lambda done: sorted((r["position"], r["problem"]) for r in graph.resume_violations(done, expected).collect())
    assert problems(rows((1, "a"), (2, "b"))) == [] == problems(expected)
    assert problems(rows((1, "a"), (3, "c"))) == [(2, "missing")]
    assert problems(rows((1, "x"), (2, "b"), (2, "b"), (9, "z"))) == [(1, "changed"), (2, "repeated"), (3, "missing"), (9, "unexpected")]
    assert problems(expected.limit(0)) == []
    assert tuple(graph.resume_position(rows((1, "a"), (2, "b")), expected).first()) == (3, 0)
    assert tuple(graph.resume_position(expected, expected).first()) == (None, 0)
    assert tuple(graph.resume_position(rows((1, "a"), (3, "c")), expected).first()) == (2, 1)


def test_repeated_writes_store_each_key_once(spark, tmp_path):
    path = str(tmp_path / "edges")
    first = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, graph.append_new(path, first, "k").collect())) == [(1, "a"), (2, "c")]
    again = graph.append_new(path, spark.createDataFrame([(1, "z"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_policies_render_exact_spans_and_tampering_is_found(spark):
    rules = spark.createDataFrame([("v1", policy.FLEET_RULE, "region-x", "2026-09-15T17:00:00.000000Z"), ("v2", policy.REGION_RULE, "region-y", None)],
                                  "policy_version_id string, rule_kind string, required_region_id string, evaluation_time string")
    rendered = policy.render(rules)
    assert policy.render_violations(rendered).count() == 0
    for row in rendered.collect():
        assert row["required_region_id"] in row["text"]
        assert len(row["clauses"]) == (2 if row["rule_kind"] == policy.FLEET_RULE else 1)
        for c in row["clauses"]:
            body = row["text"][c["span_start"]:c["span_end"]]
            assert row["text"][c["span_end"]] == "\n" and row["text"][c["span_start"] - 1] == "\n" and body.endswith(".")
    assert "INCIDENT_STATUS=open" in rendered.where("policy_version_id = 'v1'").first()["text"]
    changed = rendered.withColumn("text", F.replace("text", F.lit("active"), F.lit("passive")))
    assert {r["violation"] for r in policy.render_violations(changed).collect()} == {"a clause does not match its place in the text"}


def test_bridge(spark):
    members = spark.createDataFrame([("d1", "f1"), ("d2", "f1"), ("d3", "f2")], "driver_id string, fleet_id string")
    bases = spark.createDataFrame([("f1", "R", "R"), ("f2", "S", "R")], "fleet_id string, region_id string, required_region_id string")
    incidents = spark.createDataFrame([("d2",)], "driver_id string")
    assert [r["driver_id"] for r in policy.bridge(members, bases, incidents).collect()] == ["d1"]


MANIFEST = ("scenario_id string, mutation_type string, parent_variant_id string, mutation_spec string, gold_track string, task_id string, "
            "foundation_task string, public_snapshot_refs array<string>, semantic_case_ids array<string>, query_ids array<string>, seed int")
MASK = '{"seed_record_ids":["a"],"removed_record_ids":["b"],"closure_policy":"remove_dependents","invariant_refs":["i"]}'
GOOD = ("ok", "observation_mask", "p", MASK, "source_grounded", "T02", None, ["s"], ["a", "b"], ["q"], 42)


@pytest.mark.parametrize("field,value,violation", [
    (None, None, None), ("mutation_type", "edit", "unknown mutation type"), ("parent_variant_id", None, "a mutation without a parent"),
    ("mutation_spec", "{}", "mutation details do not fit the type"),
    ("mutation_spec", MASK.replace("remove_dependents", "keep"), "mutation details do not fit the type"),
    ("mutation_spec", MASK.replace('["a"]', "[]"), "mutation details do not fit the type"),
    ("mutation_spec", MASK.replace('"seed', '"extra":1,"seed'), "mutation details do not fit the type"),
    ("gold_track", "x", "unknown gold track"), ("task_id", "T99", "unknown task"), ("task_id", None, "neither one task nor one foundation task"),
    ("foundation_task", "state", "neither one task nor one foundation task"), ("seed", 7, "another seed"),
    ("query_ids", [], "query_ids is empty"), ("query_ids", ["b", "a"], "query_ids is not sorted without repeats"),
    ("semantic_case_ids", ["a", "a"], "semantic_case_ids is not sorted without repeats")])
def test_manifest_rules(spark, field, value, violation):
    row = list(GOOD)
    if field:
        row[[f.split()[0] for f in MANIFEST.split(", ")].index(field)] = value
    got = {r["violation"] for r in manifest.violations(spark.createDataFrame([tuple(row)], MANIFEST)).collect()}
    assert got == ({violation} if violation else set()) or (field == "mutation_type" and violation in got)


def test_base_manifest_and_unknown_keys(spark):
    base = ("b", "base", None, "{}", *GOOD[4:])
    wrong = ("w", "base", "p", "{}", *GOOD[4:])
    got = [tuple(r) for r in manifest.violations(spark.createDataFrame([base, wrong], MANIFEST)).collect()]
    assert got == [("w", "a base has a parent or a mutation")]
    lines = spark.createDataFrame([('{"seed":42,"unexpected":true}',)], "value string")
    assert [r["unknown_key"] for r in manifest.unknown_keys(lines, ["seed"]).collect()] == ["unexpected"]


def test_counterfactuals_change_results(spark):
    """Payload hash, identity and span change with a causal input."""
    row = spark.range(1).select(
        (identity.payload_hash(F.lit('{"a":1}')) != identity.payload_hash(F.lit('{"a":2}'))).alias("a"),
        (identity.payload_hash(F.lit('{"a":1,"commit_seq":1}')) == identity.payload_hash(F.lit('{"commit_seq":2,"a":1}'))).alias("b")).first()
    assert tuple(row) == (True, True)
