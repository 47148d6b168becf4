import json

from reelgrain.operators.nested import artifacts_table, events_table, findings_table, objects, transitions_table

SCHEMA = "report_id bigint, body string, k string, n string, object string"


def found(spark, bodies):
    return sorted(tuple(r) for r in objects(spark.createDataFrame([(i, b, "x", "y", "z") for i, b in bodies], SCHEMA)).collect())


def test_shapes_and_places(spark):
    finding = {"type": "t", "artifact_references": ["a.png", None, {"path": "b"}]}
    body = {
        "temporal": {"notable_transitions": {"transition_id": "only"}},
        "unified_evidence": json.dumps({"events": [None, {"findings": [finding, None, finding], "artifact_references": "one.png"}], "ambiguous_findings": finding}),
    }
    got = found(spark, [(1, json.dumps(body))])
    assert (1, "notable_transition", -1, -1, 0) in got
    assert (1, "event", 1, -1, 1) in got and (1, "event", 0, -1, 0) not in got
    assert {(1, "finding", 1, -1, 0), (1, "finding", 1, -1, 2), (1, "finding", -1, -1, 0)} <= set(got)
    assert {(1, "artifact_reference", 1, -1, 0), (1, "artifact_reference", 1, 2, 2), (1, "artifact_reference", -1, 0, 0)} <= set(got)
    assert (1, "artifact_reference", 1, 0, 1) not in got
    assert len(got) == 1 + 1 + 3 + 1 + 6


def test_nothing_to_find(spark):
    for body in (None, "", "   ", "not json", "[]", "3", "{}", '{"temporal_analysis": null, "unified_evidence": "broken {"}', '{"unified_evidence": {"events": [], "ambiguous_findings": null}}', '{"unified_evidence": {"events": [null, 3, "x"]}}'):
        assert found(spark, [(1, body)]) == []
    assert found(spark, []) == []


def test_repeated_rows_and_long_bodies(spark):
    long = json.dumps({"temporal_analysis": {"notable_transitions": [{"i": i, "text": "x" * 50} for i in range(20_000)]}})
    got = found(spark, [(1, long), (1, long)])
    assert len(got) == 20_000 and got[-1][-1] == 19_999


def test_fields_of_findings(spark):
    body = json.dumps({"unified_evidence": {"events": {"findings": {"candidate_id": "c", "domain": "audio", "type": "t"}}}})
    rows = findings_table(spark.createDataFrame([(7, body)], "report_id bigint, body string")).collect()
    assert [(r.report_id, r.event_pos, r.pos, r.candidate_id, r.domain, r.summary) for r in rows] == [(7, 0, 0, "c", "audio", None)]


def test_typed_tables_of_each_kind(spark):
    body = {
        "temporal_analysis": {"notable_transitions": [{"transition_id": "t", "from_sample_index": "3", "to_sample_index": 4.0, "end_timestamp_seconds": "1.5", "metrics": {"perceptual_hash_distance": 2}, "optical_flow": {"mean_magnitude": "x"}}, None, 7]},
        "unified_evidence": {"events": [{"event_id": "e", "start_timestamp_seconds": 1, "evidence_domains": ["a", "b"], "findings": [{"candidate_id": "c", "metrics": {"m": "58.2", "n": "low", "a": 1}, "source_observation_ids": "one", "artifact_references": [{"path": "p", "size_bytes": "12", "role": "r"}, "bare.png"]}]}]},
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (1, json.dumps(body)), (2, None)], "report_id bigint, body string")
    (t,) = transitions_table(df).collect()
    assert (t.report_id, t.pos, t.transition_id, t.from_sample_index, t.to_sample_index, t.start_timestamp_seconds, t.end_timestamp_seconds, t.perceptual_hash_distance, t.mean_magnitude) == (1, 0, "t", 3, 4, None, 1.5, 2.0, None)
    (e,) = events_table(df).collect()
    assert (e.event_id, e.start_timestamp_seconds, e.evidence_domains) == ("e", 1.0, ["a", "b"])
    (f,) = findings_table(df).collect()
    assert [tuple(m) for m in f.metrics] == [("a", 1.0), ("m", 58.2), ("n", None)] and f.source_observation_ids == ["one"] and (f.event_pos, f.pos) == (0, 0)
    assert {(a.event_pos, a.finding_pos, a.pos, a.path, a.role, a.size_bytes) for a in artifacts_table(df).collect()} == {(0, 0, 0, "p", "r", 12), (0, 0, 1, "bare.png", None, None)}
