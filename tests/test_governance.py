"""Registries, records, column profiles and source metadata on small literal tables."""

import json

import pytest

from reelgrain.operators import audit, columns, records, registry, sourcing
from reelgrain.operators import validation as va

AUDIT = "sample_id string, expected_label string, notes string, `media.duration_seconds` string, feature_a string, feature_b string, fixed string, hollow string, mixed string, `audio_summary.rms` string"


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i, (label, a) in enumerate([("real", 10), ("real", 11), ("real", 12), ("ai_generated", 30), ("ai_generated", 31), ("ai_generated", 32)]):
        rows.append((f"{label}-{i}", label, "n/a", str(-a if i == 5 else a), str(a), str(10 * a), "x", " ", "abc123" if i == 0 else "3" if i < 4 else None, None if i < 3 else "0.5"))
    return spark.createDataFrame(rows, AUDIT)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_profiles_categories_and_quality(table):
    found = by(columns.full_audit(table, table.columns, "expected_label"), "column_name")
    status = {k: r.status for k, r in found.items()}
    assert status == {
        "sample_id": "possible_leakage", "expected_label": "target", "notes": "possible_leakage", "media.duration_seconds": "invalid_numeric", "feature_a": "candidate", "feature_b": "candidate",
        "fixed": "constant", "hollow": "fully_empty", "mixed": "invalid_numeric", "audio_summary.rms": "constant",
    }
    assert found["mixed"].detected_type == "mixed_numeric" and found["mixed"].invalid_numeric == 1 and found["mixed"].mode_number == 3.0
    assert found["audio_summary.rms"].missing_real == 3 and found["audio_summary.rms"].missing_ai_generated == 0
    assert found["hollow"].flags == ["fully_empty", "missing_heavy"] and found["media.duration_seconds"].invalid_numeric == 1


def test_tables_drawn_from_profiles(table):
    rows = columns.full_audit(table, table.columns, "expected_label")
    missing = by(columns.missing_table(rows), "column_name")
    assert missing["audio_summary.rms"].differs_by_class and missing["audio_summary.rms"].interpretation.startswith("absence") and missing["hollow"].fully_empty
    assert {r.column_name for r in columns.constant_table(rows).collect()} == {"fixed", "hollow", "notes", "audio_summary.rms"}
    schema = by(columns.model_schema(rows), "column_name")
    assert {k for k, r in schema.items() if r.role == "included"} == {"feature_a", "feature_b"} and "expected_label" not in schema
    bad = {(r.column_name, r.key, r.reason) for r in columns.invalid_cells(table, ["mixed", "media.duration_seconds"], "expected_label", "sample_id").collect()}
    assert bad == {("mixed", "real-0", "mixed text"), ("media.duration_seconds", "ai_generated-5", "negative")}
    assert columns.readiness(table, rows, "expected_label", ("sample_id",)).first().decision == "insufficient_dataset_size"
    assert columns.readiness(table, rows, "expected_label", ("sample_id",), least=1, per_class=1).first().decision == "requires_cleanup"
    clean = table.select("sample_id", "expected_label", "feature_a")
    kept = columns.full_audit(clean, clean.columns, "expected_label")
    assert columns.readiness(clean, kept, "expected_label", ("sample_id",), least=1, per_class=1).first().decision == "audit_passed_for_experimentation"
    assert columns.readiness(clean.unionByName(clean), kept, "expected_label", ("sample_id",), least=1, per_class=1).first().decision == "requires_cleanup"


def test_empty_table_and_clashing_names(spark, table):
    none = table.filter("false")
    assert columns.full_audit(none, none.columns, "expected_label").isEmpty()
    odd = table.withColumnsRenamed({"feature_a": "label", "feature_b": "value", "fixed": "n"}).select("sample_id", "expected_label", "label", "value", "n")
    assert columns.full_audit(odd, odd.columns, "expected_label").count() == 5


def test_class_comparison(table):
    found = audit.compare_classes(table, ["feature_a", "feature_b", "hollow"], "expected_label", "real", "ai_generated").collect()
    assert [r.column_name for r in found] == ["feature_b", "feature_a", "hollow"]
    a = found[1]
    assert (a.mean1, a.mean2, a.mean_difference, a.median_difference) == (11.0, 31.0, 20.0, 20.0) and a.overlap == "no_observed_range_overlap"
    assert a.pooled_deviation == pytest.approx((2 / 3) ** 0.5) and a.effect == pytest.approx(20 / (2 / 3) ** 0.5) and a.point_biserial == pytest.approx(10 / (100 + 2 / 3) ** 0.5)
    assert a.z == pytest.approx(-1.963961, abs=1e-6) and a.p == pytest.approx(0.0495346, abs=1e-6)
    assert found[2].comparison == "insufficient class data" and found[2].n1 == 0 and found[2].mean1 is None


def test_correlations(spark):
    rows = [(float(i), 2.0 * i, -1.0 * i * i, 7.0, None if i % 2 else float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    found = {(r.left_column, r.right_column): (r.n, r.r) for r in audit.correlations(df, list("abcde")).collect()}
    assert found["a", "b"] == (9, pytest.approx(1.0)) and found["a", "e"] == (5, pytest.approx(1.0)) and found["a", "d"] == (9, None) and len(found) == 10
    assert [(r.left_column, r.right_column) for r in audit.correlations(df, list("abc"), 0.99).collect()] == [("a", "b")]


def feature(**kw):
    base = {k: None for k in registry.FIELDS} | {"nullable": True, "required": False, "model_candidate": False, "leakage_risk": False, "derived": False, "dependencies": [], "aliases": [], "introduced_version": "0.9.4", "data_type": "float", "category": "raw_numeric"}
    return base | kw | {"export_name": kw.get("export_name", kw["id"])}


def test_registry_findings():
    good = [feature(id="raw.a", model_candidate=True), feature(id="raw.b"), feature(id="derived.ratio", derived=True, dependencies=["raw.a", "raw.b"], transformation={"type": "safe_ratio"}, category="derived_numeric")]
    assert registry.registry_findings(good) == []
    bad = [
        feature(id="x", minimum=2, maximum=1), feature(id="x", export_name="y"), feature(id="k", category="odd"), feature(id="t", data_type="odd"), feature(id="v", introduced_version="1.0"), feature(id="d", derived=True),
        feature(id="m", transformation={"type": "power"}), feature(id="l", model_candidate=True, leakage_risk=True), feature(id="s", export_name="source", model_candidate=True), feature(id="g", dependencies=["nothing"]),
        feature(id="p", deprecated_version="0.9.4", model_candidate=True), feature(id="q", category="deprecated"), feature(id="a1", aliases=["z"]), feature(id="a2", aliases=["z"]), feature(id="c1", dependencies=["c2"]), feature(id="c2", dependencies=["c1"]), {"id": "half"},
        feature(id="tt", derived=True, dependencies=["expected_label"], transformation={"type": "sum"}),
    ]
    rules = {(f, r) for _, f, r in registry.registry_findings(bad)}
    assert {("x", "repeated id"), ("x", "minimum above maximum"), ("k", "unknown category"), ("t", "unknown type"), ("v", "introduced version is none"), ("d", "derived without dependencies"), ("d", "derived without transform"), ("m", "unknown transform"), ("l", "barred as candidate"), ("s", "exposing name as candidate"), ("g", "unknown dependency nothing"), ("p", "deprecated as candidate"), ("q", "deprecated without version"), ("z", "repeated alias"), ("half", "lacks units"), ("tt", "derived from the target")} <= rules
    assert any("cycle" in r for _, r in rules)
    with pytest.raises(ValueError):
        registry.load_registry("[1]")
    with pytest.raises(ValueError):
        registry.load_registry("{broken")
    assert len(registry.load_registry(json.dumps({"features": good}))) == 3


def test_registry_over_rows(spark):
    entries = registry.typed([feature(id="raw.a", model_candidate=True, minimum=0, maximum=5, nullable=False), feature(id="raw.b", data_type="integer", model_candidate=True), feature(id="kind", data_type="categorical", allowed_values=["p", "q"]), feature(id="derived.ratio", derived=True, dependencies=["raw.a", "raw.b"], transformation={"type": "safe_ratio"}, category="derived_numeric", model_candidate=True)])
    df = spark.createDataFrame([("real-1", "real", "2", "1", "p"), ("ai-1", "ai_generated", "4", "2", "q"), ("x", "real", "9", "0", "r"), ("y", "real", None, "1.5", None), ("z", "real", "inf", "12.0", "p")], "sample_id string, expected_label string, `raw.a` string, `raw.b` string, kind string")
    found = {tuple(r) for r in registry.value_findings(df, "sample_id", entries).collect()}
    assert found == {("x", "raw.a", "out_of_range"), ("x", "kind", "invalid_type"), ("y", "raw.a", "invalid_null"), ("y", "raw.b", "invalid_type"), ("z", "raw.a", "invalid_type")}
    made = by(registry.derived(df, entries), "sample_id")
    assert made["real-1"]["derived.ratio"] == made["ai-1"]["derived.ratio"] == 2.0 and made["x"]["derived.ratio"] is None and made["y"].missing_dependencies == 1
    document = registry.schema_document(entries, "0.9.4")
    assert document["feature_order"] == ["raw.a", "raw.b", "derived.ratio"] and document["excluded"][0]["reason"] == "not a model candidate" and len(document["schema_fingerprint"]) == 64
    rows = by(registry.standardised(registry.derived(df, entries), entries, document, "sample_id", "expected_label").select("sample.sample_id", "features.*"), "sample_id")
    assert rows["z"]["raw.a"] is None and rows["z"]["raw.b"] == 12 and rows["y"]["raw.b"] is None
    turned = registry.schema_document([entries[1], entries[0], *entries[2:]], "0.9.4")
    assert registry.compatibility(document, document) == ("compatible", []) and registry.compatibility(document, turned)[0] == "requires_regeneration"
    wider = registry.typed([feature(id="raw.a", model_candidate=True, minimum=0, maximum=6, nullable=False), *[feature(id="raw.b", data_type="integer", model_candidate=True)]])
    status, changes = registry.compatibility(document, registry.schema_document(wider, "0.9.5"))
    assert status == "incompatible" and ("breaking", "raw.a: maximum") in changes and ("breaking", "removed derived.ratio") in changes
    assert registry.lineage(entries)[0]["dependencies"] == ["raw.a", "raw.b"] and registry.evolution(entries, {"raw.a": "a"})[0]["renamed_from"] == "a"
    profile = registry.preparation_profile(df, entries, "sample_id", "0.9.4").first()
    assert (profile.sample_count, profile.invalid_type_count, profile.out_of_range_count, profile.missing_dependency_count, profile.unregistered_field_count) == (5, 3, 1, 1, 2)
    assert {c[1:] for c in registry.column_findings(df.columns, registry.typed([feature(id="raw.a", deprecated_version="1.0.0"), feature(id="gone", required=True)]))} >= {("raw.a", "deprecated"), ("gone", "missing_required"), ("kind", "unregistered")}


REPORT = {
    "analysis": {"analysis_id": "an-1"}, "analysis_environment": {"application_version": "0.9.4"}, "source": {"filename": "a.mp4", "sha256": "f" * 64},
    "metadata": {"container": {"duration_seconds": "12.5", "tags": {"creation_time": "2025"}}, "video": {"width": 640, "height": "360", "frame_rate_decimal": True, "frame_count": {"reported_by_stream": None, "estimated_from_duration": 300}}, "audio": {"present": True}, "encoding": {"container_encoder": None}, "duration_comparison": {"duration_only_difference_seconds": 0}},
    "frame_analysis": {"summary": {"frames_analyzed": 12, "average_brightness": 91.5, "heuristic_near_black_frame_count": 1, "heuristic_near_white_frame_count": None}},
    "temporal_analysis": {"summary": {"transitions_analyzed": 60, "average_flow_magnitude": "nan"}, "notable_transitions": [{}, {}]},
    "audio_analysis": {"notable_transitions": [{"rms_ratio": 2.5}, {"energy_change_ratio": "4"}, {}], "silence_intervals": [{}]},
    "visual_consistency_analysis": {"ranked_review_transitions": [{"regional_summary": {"unstable_region_count": 4, "maximum_edge_instability": 0.5}}, {"regional_summary": {"maximum_edge_instability": 0.7}}]},
    "unified_evidence": json.dumps({"summary": {"timeline_event_count": 3}, "review_highlights": [{"review_priority": {"level": "high"}, "cross_modal_context": {"classification": "visual_and_audio_aligned"}, "independent_group_count": 2}, {"review_priority": {"level": "low"}}]}),
    "d3": {"execution": {"status": "completed"}, "native_output": {"raw_score": 0.4, "calibration_status": "uncalibrated"}},
}


def test_reports_to_feature_records(spark):
    df = spark.createDataFrame([(1, json.dumps(REPORT)), (2, None), (3, "[1]"), (4, '{"temporal": {"notable_transitions": null}}')], "report_id bigint, body string")
    rows = by(audit.flatten(records.feature_record(df), keep=("report_id",)), "report_id")
    one = rows[1]
    want = {
        "identity.analysis_id": "an-1", "identity.video_name": "a.mp4", "media.duration_seconds": 12.5, "media.height": 360, "media.frame_rate": None, "media.frame_count": 300, "media.audio_present": True, "metadata_indicators.creation_time_present": True,
        "metadata_indicators.encoder_metadata_present": False, "metadata_indicators.duration_metadata_consistent": True, "frame_summary.sampled_frame_count": 12, "frame_summary.dark_frame_ratio": 0.083333, "frame_summary.white_frame_ratio": None,
        "temporal_summary.notable_transition_count": 2, "temporal_summary.mean_motion_magnitude": None, "audio_summary.ranked_audio_transition_count": 3, "audio_summary.silence_interval_count": 1, "audio_summary.clipping_interval_count": 0, "audio_summary.maximum_audio_energy_change": 4.0,
        "visual_consistency_summary.maximum_unstable_region_count": 4, "visual_consistency_summary.maximum_edge_instability": 0.7, "unified_evidence_summary.timeline_event_count": 3, "unified_evidence_summary.high_priority_event_count": 1, "unified_evidence_summary.cross_modal_event_count": 1,
        "unified_evidence_summary.maximum_independent_evidence_group_count": 2, "d3_summary.d3_status": "completed", "d3_summary.d3_raw_score": 0.4,
    }
    assert {k: one[k] for k in want} == want
    assert rows[2]["d3_summary.d3_status"] == rows[3]["d3_summary.d3_status"] == "not_run" and rows[2]["unified_evidence_summary.high_priority_event_count"] == 0
    assert rows[4]["temporal_summary.notable_transition_count"] == 0 and rows[2]["temporal_summary.notable_transition_count"] is None


def test_record_and_dataset_rules(spark):
    df = spark.createDataFrame([(1, json.dumps(REPORT))], "report_id bigint, body string")
    from pyspark.sql import functions as F

    good = records.feature_record(df, F.lit("real"))
    bad = (
        good.withColumn("frame_summary", F.col("frame_summary").withField("dark_frame_ratio", F.lit(1.5)).withField("sampled_frame_count", F.lit(-1).cast("bigint")))
        .withColumn("identity", F.col("identity").withField("video_name", F.lit("/a.mp4"))).withColumn("d3_summary", F.col("d3_summary").withField("d3_calibration_status", F.lit("calibrated")))
    )
    broken = lambda d: {r.rule for r in va.violations(d, ["report_id"], records.record_rules(d)).collect()}
    assert broken(good) == set()
    assert broken(bad) == {"ratio_outside frame_summary.dark_frame_ratio", "count_negative frame_summary.sampled_frame_count", "absolute_path identity.video_name", "score_calibrated"}
    manifest = spark.createDataFrame(
        [(1, "s1", "real", "aa", "f/1.json"), (2, "s1", "real", "aa", "f/1.json"), (3, None, "odd", None, "f/3.json"), (4, "s4", "real", "dd", "../x.json"), (5, "s5", "real", "ee", "C:\\x.json"), (6, "s6", "real", "ff", ""), (7, "s7", "ai_generated", "gg", "f/7.json"), (8, "s8", "real", "hh", "f/8.json")],
        "entry_id bigint, sample_id string, expected_label string, video_sha256 string, feature_file string",
    )
    held = spark.createDataFrame([("s1", "aa", "real", 0), ("s7", "zz", "real", 2)], "sample_id string, video_sha256 string, expected_label string, errors int")
    found = records.dataset_findings(manifest, held)
    assert {tuple(r) for r in found.collect()} == {
        (2, "sample_id repeated"), (3, "sample_id missing"), (3, "label invalid"), (3, "record missing"), (4, "feature_file unsafe"), (5, "feature_file unsafe"), (6, "feature_file missing"), (7, "digest differs"), (7, "label differs"), (7, "record invalid"), (8, "record missing"),
    }
    state = records.dataset_state(manifest, found).first()
    assert (state.lines, state.valid, state.invalid, state.repeated_digests, state.status) == (8, 1, 7, 1, "invalid")


def lines(spark, *files):
    rows = [(i, name, n, line, None) for name, texts in files for n, line in enumerate(texts, 1) for i in [hash((name, n)) % 10**9]]
    return spark.createDataFrame(rows, "raw_id bigint, file_name string, line_no int, raw_line string, received_at string")


def test_source_metadata(spark):
    rows = lines(
        spark,
        ("a.csv", ["path,label,method,compression,frames,width,height,codec", "v/one.mp4,original,,raw,100,640,360,h264", "v/two.mp4,Fake,swap,c23,1e2,640,360,", "v/two.mp4,Fake,swap,c23,1e2,640,360,", "..\\x.mp4,deepfake,swap,raw,,,,", "v/dup.mp4,real,,,,,,", "gone.mp4,what,,,,,,"]),
        ("b.csv", ["Video Path;Class", "C:\\v\\x.png;0", ";1"]),
    )
    found = {(r.file_name, r.source_row_id): r for r in sourcing.normalised(rows).collect()}
    one = found["a.csv", 1]
    assert (one.video_name, one.normalised_label, one.frame_count, one.compression, one.manipulation_method) == ("one.mp4", "real", 100, "raw", None)
    assert found["a.csv", 2].frame_count is None and found["a.csv", 4].path_invalid and found["a.csv", 4].source_video_path is None and found["a.csv", 6].normalised_label is None
    assert found["b.csv", 1].normalised_label == "real" and found["b.csv", 1].path_invalid
    listing = spark.createDataFrame([("videos/one.mp4",), ("x/dup.mp4",), ("y/dup.mp4",)], "path string")
    audits = by(sourcing.audit(rows, listing), "file_name")
    a = audits["a.csv"]
    assert (a.rows, a.duplicate_rows, a.duplicate_paths, a.real, a.ai_generated, a.unmapped, a.methods, a.path_style, a.row_representation) == (6, 1, 1, 2, 3, 1, 1, "windows_relative", "videos")
    assert (a.video_found, a.video_missing, a.ambiguous_video_match, a.invalid_metadata) == (1, 2, 1, 2)
    assert audits["b.csv"].path_style == "windows_absolute" and audits["b.csv"].row_representation == "extracted_frames"
    types = {(r.file_name, r.column_name): (r.missing, r.inferred_type) for r in sourcing.column_audit(rows).collect()}
    assert types["a.csv", "frames"] == (3, "number") and types["a.csv", "width"] == (3, "integer") and types["b.csv", "class"] == (0, "integer")
    chosen = sourcing.plan(sourcing.availability(sourcing.normalised(rows), listing), {"real": 2, "ai_generated": 5})
    plan = chosen.orderBy("plan_index").collect()
    assert [r.plan_index for r in plan] == [1, 2, 3, 4, 5] and [r.expected_label for r in plan] == ["ai_generated"] * 3 + ["real"] * 2
    assert {r.video_name for r in plan[:3]} == {"two.mp4", "x.mp4", None} and "one.mp4" in {r.video_name for r in plan[3:]}
    assert {tuple(r) for r in sourcing.shortages(chosen, {"real": 2, "ai_generated": 5}).collect()} == {("real", 2, 2, 0), ("ai_generated", 5, 3, 2)}


def test_plan_rules(spark):
    plan = spark.createDataFrame(
        [(1, 1, "s", "m.csv", "1", "a.mp4", "real", 42, True, "v/a.mp4"), (2, 1, "s", "m.csv", "2", "b.mp4", "odd", 42, True, "v/a.mp4"), (3, 3, "s", None, "3", "c.mp4", "real", 42, True, "v/gone.mp4"), (4, 4, "s", "m.csv", "4", "d.mp4", "real", 42, False, "../d.mp4")],
        "line_no int, plan_index int, source_dataset string, metadata_source_file string, source_row_id string, video_name string, expected_label string, selection_seed int, video_available boolean, resolved_path string",
    )
    listing = spark.createDataFrame([("v/a.mp4",)], "path string")
    assert {tuple(r) for r in sourcing.plan_findings(plan, listing).collect()} == {(2, "index not rising"), (2, "label invalid"), (2, "path repeated"), (3, "lacks metadata_source_file"), (3, "video vanished"), (4, "path unsafe")}
