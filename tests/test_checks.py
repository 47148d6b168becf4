"""Report checks, observations, compact reports and the evidence timeline on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from reelgrain.operators import checks as ck
from reelgrain.operators import timeline as tl


def test_leaves_and_text_rules(spark):
    body = {"a": {"Probability": 1, "rows": [{"verdict": None, "count": -1}]}, "path": "C:\\x", "artifact_path": "ok/x", "description": "Tampering is CONFIRMED", "big": 10**400, "n": [1.5, True]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, '{"x": NaN}'), (3, None), (4, "broken {")], "report_id bigint, body string")
    leaves = ck.json_leaves(df)
    assert {tuple(r) for r in ck.text_findings(leaves, ("probability", "verdict")).collect()} == {
        (1, "a.Probability", "forbidden key"), (1, "a.rows[0].verdict", "forbidden key in list"), (1, "a.rows[0].count", "negative count"), (1, "path", "absolute path"), (1, "description", "claims a verdict"), (2, "x", "not finite"),
    }
    assert leaves.filter("path = 'n'").first().number == 2.0 and ck.json_leaves(df.filter("false")).isEmpty()


def test_pairs_summaries_and_times(spark):
    frames = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 2.0), (2, 0, 0.0)], "entity bigint, sample_index int, seconds double")
    pairs = spark.createDataFrame([(1, 0, 1, 0.0, 1.0), (1, 1, 9, 1.0, 2.0), (1, 2, 1, 2.0, 1.5)], "entity bigint, from_index int, to_index int, start_seconds double, end_seconds double")
    assert {tuple(r) for r in ck.pair_findings(frames, pairs).collect()} == {(1, 1, 9, "unknown frame"), (1, 2, 1, "end differs"), (1, 2, 1, "not consecutive")}
    assert [tuple(r) for r in ck.pair_counts(frames, pairs).collect()] == [(1, 3, 3)]
    a = spark.createDataFrame([(1, 2.0, None), (2, None, 1.0005)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 2.002, None), (2, 1.0, 1.0)], "k int, x double, y double")
    assert {(r.k, r.name) for r in ck.summary_findings(a, b, ["k"]).collect()} == {(1, "x"), (2, "x")}
    times = spark.createDataFrame([(1, "2025-01-01T00:00:00", "2025-01-02"), (2, "2025-01-03", "2025-01-02"), (3, "soon", None)], "k int, a string, b string")
    assert {tuple(r) for r in ck.time_findings(times, "k", "a", "b").collect()} == {(2, "completed before started"), (3, "time missing or invalid")}


def test_metadata_and_stage_rules(spark):
    df = spark.createDataFrame([(1, True, "enc", None, 12.3, 2, "h264"), (2, False, None, "2025", 25.0, 1, None)], "k int, audio_present boolean, encoder string, creation_time string, frame_rate double, stream_count int, video_codec string")
    found = {(r.k, r.observation_id, r.type) for r in ck.metadata_observations(df, "k").collect()}
    assert found == {
        (1, "metadata-fact-001", "audio_stream_present"), (1, "metadata-fact-002", "encoder_tag_present"), (1, "missing-metadata-003", "creation_time_missing"), (1, "metadata-fact-004", "unusual_frame_rate_value"), (1, "metadata-fact-005", "multiple_streams"), (1, "metadata-fact-006", "h264_video_codec"),
        (2, "missing-metadata-001", "audio_stream_missing"), (2, "missing-metadata-002", "encoder_tag_missing"), (2, "metadata-fact-003", "creation_time_present"), (2, "missing-metadata-004", "video_codec_missing"),
    }
    stage = spark.createDataFrame([(1, True, 2, 0, 0.0, None, 0.4)], "k int, encoders_missing boolean, audio_transitions int, regional_transitions int, clipping_ratio double, static_intervals int, duration_difference double")
    sides = {(r.side, r.type) for r in ck.stage_findings(stage, "k").collect()}
    assert {t for s, t in sides if s == "ambiguous"} == {"missing_encoder_metadata", "audio_energy_changes"} and {t for s, t in sides if s == "normal"} == {"no_clipping_like_samples", "no_sustained_near_static_intervals"} and len(sides) == 8
    runs = spark.createDataFrame([("real", True, False, True, True, False), (None, None, None, False, None, None)], "label string, copied boolean, duplicate boolean, analysed boolean, registered boolean, existing boolean")
    assert tuple(ck.run_counters(runs).first()) == (2, 1, 0, 1, 1, 0, 1, 1, 1, 0)


def test_compact_reports_climb_down(spark):
    rows = [(1, p, "s" * 60, {"m": p}, [{"summary": "f" * 50}] * 6, [f"a{i}" for i in range(6)]) for p in range(1, 8)] + [(2, 1, "s", {"m": 1}, [], [])]
    df = spark.createDataFrame(rows, "entity int, place int, summary string, metrics map<string,int>, findings array<struct<summary:string>>, artifacts array<string>")
    sizes = {}
    for preferred in (100_000, 1900, 900, 400, 10):
        found = {r.entity: r for r in ck.compact_reports(df, preferred, 600).collect()}
        sizes[preferred] = found[1].rung
        assert found[1].bytes == len(found[1].report) and (found[1].bytes <= preferred or preferred == 10) and found[1].fits == (found[1].bytes <= 600)
    assert sizes[100_000] == 0 and list(sizes.values()) == sorted(sizes.values()) and sizes[10] == len(ck.RUNGS) - 1
    assert {r.rule for r in ck.compact_findings(ck.compact_reports(df, 100_000), 4, 500).collect()} == {"too large", "too many events"}


SCHEMA = "entity bigint, id bigint, source_type string, domain string, record_id string, start_seconds double, end_seconds double"
V, A, R, C = ("ranked_review_transition", "visual_temporal"), ("ranked_audio_energy_transition", "audio_signal"), ("ranked_visual_consistency_transition", "visual_consistency"), ("sampled_frame_comparison", "frame_sampling")


def timeline(spark, *rows):
    df = spark.createDataFrame([(1, i, *kind, f"r{i}", a, b) for i, (kind, a, b) in enumerate(rows)], SCHEMA)
    found = tl.with_roles(df)
    events, linked = tl.members(found)
    assert tl.violations(found, events, linked).isEmpty()
    return found, linked, {r.event: r for r in tl.finalised(found, events, linked).collect()}


def test_aligned_and_separated(spark):
    _, _, one = timeline(spark, (R, 1.0, 1.2), (A, 1.05, 1.2))
    assert len(one) == 1 and (one[1]["class"], one[1].group_count, one[1].priority) == ("visual_and_audio_aligned", 2, "high")
    assert len(timeline(spark, (R, 1.0, 1.2), (A, 3.0, 3.25))[2]) == 2


def test_a_long_support_bridges_nothing(spark):
    support = ("sustained_regional_visual_variation", "visual_consistency")
    _, linked, two = timeline(spark, (V, 0.8, 1.0), (V, 2.8, 3.0), (support, 0.5, 3.5))
    assert len(two) == 2 and all(e.end_seconds - e.start_seconds < 1 for e in two.values())
    assert {(r.event, r.id, r.relation) for r in linked.collect()} == {(1, 0, "anchor"), (2, 1, "anchor"), (2, 2, "primary"), (1, 2, "context")}


def test_tolerance_and_span(spark):
    assert len(timeline(spark, (V, 0.0, 0.2), (V, 0.4, 0.5))[2]) == 1
    _, linked, found = timeline(spark, *((V, round(0.3 * i, 1), round(0.3 * i + 0.1, 1)) for i in range(5)))
    assert len(found) == 2 and sorted(r.event for r in linked.collect()) == [1, 1, 1, 1, 2]


def test_context_does_not_stretch_an_event(spark):
    static = ("sustained_near_static_interval", "visual_temporal")
    _, _, found = timeline(spark, (V, 4.0, 4.2), (static, 4.2, 5.0))
    assert len(found) == 1 and found[1].end_seconds == 4.2 and found[1].context_count == 1


def test_an_unmatched_support_is_its_own_event(spark):
    support = ("sustained_regional_visual_variation", "visual_consistency")
    _, _, found = timeline(spark, (V, 0.0, 0.1), (support, 9.0, 9.5))
    assert [e.standalone for e in found.values()] == [False, True] and found[2].priority == "low"


def test_caps_keep_every_domain(spark):
    rows = [(R, 1.0, 1.1)] * 7 + [(V, 1.0, 1.1), (A, 1.0, 1.1), (R, 1.05, 1.1)]
    found, linked, _ = timeline(spark, *rows)
    shown = tl.findings(found, linked).collect()
    assert sum(r.domain == "visual_consistency" for r in shown) == 3 and {r.domain for r in shown} == {"visual_consistency", "visual_temporal", "audio_signal"} and shown[0].available == 10
    alone, linked, _ = timeline(spark, *[(R, 1.0, 1.1)] * 6)
    assert tl.findings(alone, linked).count() == 6  # one domain knows no cap


def test_highlights_are_capped(spark):
    found, _, final = timeline(spark, *((V, 0.5 * i, 0.5 * i + 0.1) for i in range(12)))
    assert len(final) == 12
    events, linked = tl.members(found)
    assert tl.highlights(tl.finalised(found, events, linked)).count() == 10


def test_distinct_findings_and_artifacts(spark):
    rows = spark.createDataFrame([(1, 1, 1, "r", "d", "t", "s", {"a": 1}), (1, 1, 2, "r", "d", "t", "s", {"a": 9}), (1, 1, 3, "r", "d", "t", "s", {"b": 1}), (1, 1, 4, None, "d", "t", "s", {"a": 1})], "entity int, event int, id int, record_id string, domain string, source_type string, summary string, metrics map<string,int>")
    assert {r.id for r in tl.distinct_findings(rows).collect()} == {1, 3, 4}
    art = spark.createDataFrame([(1, 1, "zoo", "p1"), (1, 1, "after_frame", "p2"), (1, 1, "before_frame", "p2"), (1, 1, None, "p3"), (1, 1, "combined_heatmap", ""), (1, 1, "flow_warp_residual", "p4")], "entity int, event int, label string, path string")
    assert [(r.path, r.label) for r in tl.ordered_artifacts(art).orderBy("place").collect()] == [("p2", "before_frame"), ("p4", "flow_warp_residual"), ("p3", ""), ("p1", "zoo")]


def test_regional_groups(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 1.0, ["a", "b"], 0.5, 0.2, 0.1), (1, 2, 0.5, 2.0, ["b", "c"], 0.7, 0.4, None)], "entity int, id int, start_seconds double, end_seconds double, regions array<string>, edge double, texture double, detail double")
    seeds = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "entity int, id int, seed int")
    g = tl.regional_groups(rows, seeds).first()
    assert (g.start_seconds, g.end_seconds, g.intervals, g.regions, g.maximum_edge, g.mean_detail) == (0.0, 2.0, 2, "a,b,c", 0.7, 0.1) and g.mean_texture == pytest.approx(0.3)


def test_global_evidence_numbers_what_is_there(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, None)], "k int, a string, b string")
    assert [tuple(r) for r in tl.global_evidence(df, "k", {"hash": F.col("a"), "codec": F.col("b"), "stage": F.lit("done")}).orderBy("k", "candidate_id").collect()] == [(1, "global-evidence-00001", "hash", "x"), (1, "global-evidence-00002", "stage", "done"), (2, "global-evidence-00001", "stage", "done")]
