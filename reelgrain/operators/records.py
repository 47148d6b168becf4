"""Analysis reports to flat feature records, and checks of records and of whole datasets.

A report is one JSON text. Each section is read once by `from_json` with string leaves, so that a leaf in another shape than
usual is null and not an error; numbers, counts and flags are then typed strictly.

Defined results. A body that is null or no object gives a record whose leaves are null and whose evidence counts are 0. A
section given as JSON text counts as the object it spells. Booleans are no numbers, text that is no number and infinities
are null; a count given with a fraction loses it. Arrays that are absent have no length where their section is absent, else 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrain.operators.validation import absolute_path, unsafe_path

LABELS = ("real", "ai_generated")
RATIOS = ("dark_frame_ratio", "white_frame_ratio")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A finite number, or null; true and false are none."""
    t = F.btrim(text)
    x = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def whole(text: Column) -> Column:
    """An integer: digits, or a JSON number whose fraction falls away."""
    return F.when(F.abs(number(text)) < 2.0**63, F.coalesce(F.btrim(text).try_cast("bigint"), number(text).cast("bigint")))


def flag(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def _object(text: Column, fields: str) -> Column:
    return F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text), fields)


def _list(text: Column) -> Column:
    """Entries of an array, or of one object, as texts; null where there is neither."""
    head = F.substring(F.ltrim(text), 1, 1)
    return F.when(head == "[", F.from_json(text, "array<string>")).when(head == "{", F.array(text))


def _largest(items: Column, *keys: str, kind=number) -> Column:
    """The greatest value of the first key that each object has; null without any."""
    value = lambda x: kind(F.coalesce(*(F.get_json_object(x, f"$.{k}") for k in keys)))
    return F.array_max(F.transform(items, value))


def sections(df: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """key and the sections of each report as structs of texts."""
    top = _object(F.col(body), "analysis string, analysis_environment string, source string, metadata string, frame_analysis string, temporal_analysis string, temporal string, audio_analysis string, visual_consistency_analysis string, unified_evidence string, learned_detectors string, d3 string")
    t = df.select(F.col(f"`{key}`").alias("report_id"), top.alias("t"))
    s = lambda name, fields: _object(F.col(f"t.{name}"), fields).alias(name)
    temporal = F.coalesce("t.temporal_analysis", "t.temporal")
    parts = t.select(
        "report_id", s("analysis", "analysis_id string"), s("analysis_environment", "application_version string"), s("source", "filename string, video_name string, sha256 string"),
        s("metadata", "container string, video string, audio string, encoding string, duration_comparison string"), _object(F.get_json_object("t.frame_analysis", "$.summary"), "frames_analyzed string, average_brightness string, average_contrast string, average_laplacian_variance string, heuristic_near_black_frame_count string, heuristic_near_white_frame_count string").alias("frames"),
        _object(temporal, "summary string, notable_transitions string").alias("temporal"), s("audio_analysis", "summary string, notable_transitions string, silence_intervals string, clipping_intervals string, global_metrics string"),
        s("visual_consistency_analysis", "summary string, transition_summaries string, ranked_review_transitions string, sustained_intervals string"), s("unified_evidence", "summary string, review_highlights string"),
        _object(F.coalesce("t.d3", F.get_json_object("t.learned_detectors", "$.d3")), "execution string, configuration string, preprocessing string, feature_summary string, native_output string").alias("d3"),
    )
    sub = lambda c, fields: _object(F.col(c), fields)
    return parts.withColumns({
        "container": sub("metadata.container", "duration_seconds string, tags string"), "video": sub("metadata.video", "width string, height string, frame_rate_decimal string, frame_count string, tags string"), "audio_stream": sub("metadata.audio", "present string, tags string"),
        "encoding": sub("metadata.encoding", "container_encoder string, video_stream_encoder string, audio_stream_encoder string"), "temporal_counts": sub("temporal.summary", "transitions_analyzed string, notable_transition_count string, scene_boundary_candidate_count string, sustained_near_static_interval_count string, average_flow_warp_residual string, maximum_flow_warp_residual string, average_flow_magnitude string, maximum_flow_magnitude string"),
        "audio_counts": sub("audio_analysis.summary", "window_count string, ranked_energy_transition_count string, silence_like_interval_count string"), "visual_counts": sub("visual_consistency_analysis.summary", "consistency_record_count string, ranked_review_transition_count string, sustained_interval_count string"),
        "highlights": _list(F.col("unified_evidence.review_highlights")), "transitions": _list(F.col("audio_analysis.notable_transitions")),
    })


def feature_record(df: DataFrame, label: Column | None = None, version: str = "0.10.0", key: str = "report_id", body: str = "body") -> DataFrame:
    """report_id and the nine groups of a feature record for each report."""
    s, c = sections(df, key, body), F.col
    there = lambda x, value: F.when(c(x).isNotNull(), value)
    length = lambda x: F.coalesce(F.size(_list(c(x))), F.lit(0)).cast("bigint")
    count = lambda name, otherwise: F.when(c(name).isNotNull(), whole(c(name))).otherwise(otherwise)
    share = lambda n, total: F.when(whole(c(total)) > 0, F.bround(whole(c(n)) / whole(c(total)), 6))
    frame_count = lambda k: F.get_json_object("video.frame_count", f"$.{k}")
    tags = [F.get_json_object(f"{p}.tags", "$.creation_time") for p in ("container", "video", "audio_stream")]
    differs = F.get_json_object("metadata.duration_comparison", "$.duration_only_difference_seconds")
    summaries = lambda x: F.transform(_list(c(x)), lambda i: F.get_json_object(i, "$.regional_summary"))
    given = summaries("visual_consistency_analysis.transition_summaries")
    regional = F.when(F.size(given) > 0, given).otherwise(summaries("visual_consistency_analysis.ranked_review_transitions"))
    highlights = F.coalesce("highlights", F.array().cast("array<string>"))
    at = lambda path, allowed: F.size(F.filter(highlights, lambda x: F.coalesce(F.get_json_object(x, path).isin(*allowed), F.lit(False)))).cast("bigint")
    d3 = lambda part, name: F.get_json_object(f"d3.{part}", f"$.{name}")
    groups = {
        "identity": {"feature_schema_version": F.lit(version), "application_version": c("analysis_environment.application_version"), "analysis_id": c("analysis.analysis_id"), "video_name": F.coalesce("source.filename", "source.video_name"), "video_sha256": c("source.sha256"), "expected_label": F.lit(None).cast("string") if label is None else label},
        "media": {"duration_seconds": number(c("container.duration_seconds")), "width": whole(c("video.width")), "height": whole(c("video.height")), "frame_rate": number(c("video.frame_rate_decimal")), "frame_count": whole(F.coalesce(frame_count("reported_by_stream"), frame_count("estimated_from_duration"))), "audio_present": flag(c("audio_stream.present"))},
        "metadata_indicators": {"creation_time_present": reduce(Column.__or__, (F.coalesce(t, F.lit("")) != "" for t in tags)), "encoder_metadata_present": F.coalesce("encoding.container_encoder", "encoding.video_stream_encoder", "encoding.audio_stream_encoder").isNotNull(), "duration_metadata_consistent": number(differs) == 0.0},
        "frame_summary": {"sampled_frame_count": whole(c("frames.frames_analyzed")), "mean_brightness": number(c("frames.average_brightness")), "mean_contrast": number(c("frames.average_contrast")), "mean_sharpness": number(c("frames.average_laplacian_variance")), "dark_frame_ratio": share("frames.heuristic_near_black_frame_count", "frames.frames_analyzed"), "white_frame_ratio": share("frames.heuristic_near_white_frame_count", "frames.frames_analyzed")},
        "temporal_summary": {"analyzed_transition_count": whole(c("temporal_counts.transitions_analyzed")), "notable_transition_count": count("temporal_counts.notable_transition_count", there("temporal", length("temporal.notable_transitions"))), "scene_boundary_count": whole(c("temporal_counts.scene_boundary_candidate_count")), "near_static_interval_count": whole(c("temporal_counts.sustained_near_static_interval_count")), "mean_normalized_frame_difference": F.lit(None).cast("double"), "maximum_normalized_frame_difference": F.lit(None).cast("double"), "mean_flow_warp_residual": number(c("temporal_counts.average_flow_warp_residual")), "maximum_flow_warp_residual": number(c("temporal_counts.maximum_flow_warp_residual")), "mean_motion_magnitude": number(c("temporal_counts.average_flow_magnitude")), "maximum_motion_magnitude": number(c("temporal_counts.maximum_flow_magnitude"))},
        "audio_summary": {"audio_window_count": whole(c("audio_counts.window_count")), "ranked_audio_transition_count": count("audio_counts.ranked_energy_transition_count", there("audio_analysis", length("audio_analysis.notable_transitions"))), "silence_interval_count": count("audio_counts.silence_like_interval_count", there("audio_analysis", length("audio_analysis.silence_intervals"))), "clipping_interval_count": there("audio_analysis", length("audio_analysis.clipping_intervals")), "maximum_audio_energy_change": _largest(c("transitions"), "energy_change_ratio", "rms_ratio"), "mean_audio_rms": number(F.get_json_object("audio_analysis.global_metrics", "$.rms_amplitude"))},
        "visual_consistency_summary": {"analyzed_region_record_count": whole(c("visual_counts.consistency_record_count")), "ranked_consistency_transition_count": count("visual_counts.ranked_review_transition_count", there("visual_consistency_analysis", length("visual_consistency_analysis.ranked_review_transitions"))), "sustained_instability_interval_count": count("visual_counts.sustained_interval_count", there("visual_consistency_analysis", length("visual_consistency_analysis.sustained_intervals"))), "maximum_unstable_region_count": _largest(regional, "unstable_region_count", kind=whole), "maximum_edge_instability": _largest(regional, "maximum_edge_instability"), "maximum_texture_distance": _largest(regional, "maximum_texture_distance"), "maximum_detail_residual": _largest(regional, "maximum_regional_detail_residual")},
        "unified_evidence_summary": {"timeline_event_count": whole(F.get_json_object("unified_evidence.summary", "$.timeline_event_count")), "high_priority_event_count": at("$.review_priority.level", ["high"]), "moderate_priority_event_count": at("$.review_priority.level", ["moderate"]), "cross_modal_event_count": at("$.cross_modal_context.classification", ["visual_and_audio_aligned", "multiple_visual_methods"]), "maximum_independent_evidence_group_count": _largest(highlights, "independent_group_count", kind=whole)},
        "d3_summary": {"d3_status": F.when(c("d3").isNull(), "not_run").otherwise(d3("execution", "status")), "d3_raw_score": number(d3("native_output", "raw_score")), "d3_encoder": d3("configuration", "encoder"), "d3_distance_mode": d3("configuration", "distance_mode"), "d3_selected_frame_count": whole(d3("preprocessing", "actual_selected_frame_count")), "d3_first_order_value_count": whole(d3("feature_summary", "first_order_value_count")), "d3_second_order_value_count": whole(d3("feature_summary", "second_order_value_count")), "d3_second_order_mean": number(d3("feature_summary", "second_order_mean")), "d3_second_order_standard_deviation": number(d3("feature_summary", "second_order_standard_deviation")), "d3_calibration_status": d3("native_output", "calibration_status"), "d3_score_direction": d3("native_output", "score_direction")},
    }
    return s.select("report_id", *(F.struct(*(v.alias(k) for k, v in leaves.items())).alias(g) for g, leaves in groups.items()))


def with_manifest(flat: DataFrame, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """Feature rows with the seven manifest columns of their sample; a sample listed twice gives the row twice."""
    columns = ("expected_label", "feature_file", "source", "generator_or_camera", "notes", "added_at")
    return flat.drop(*columns).join(manifest.select(key, *columns), key)


def record_rules(df: DataFrame) -> dict[str, Column]:
    """Name -> condition that is true where a feature record breaks it, for every leaf of the structs."""
    leaves = [(g.name, f.name, f.dataType) for g in df.schema if isinstance(g.dataType, T.StructType) for f in g.dataType]
    c = lambda g, n: F.col(f"{g}.{n}")
    label, rules = c("identity", "expected_label"), {}
    rules["label_invalid"] = ~F.coalesce(label.isin(*LABELS), F.lit(False))
    rules["score_calibrated"] = c("d3_summary", "d3_raw_score").isNotNull() & ~F.coalesce(c("d3_summary", "d3_calibration_status") == "uncalibrated", F.lit(False))
    for g, n, kind in leaves:
        x, name = c(g, n), f"{g}.{n}"
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            rules[f"not_finite {name}"] = F.isnan(x) | (F.abs(x) == float("inf"))
        if n in RATIOS:
            rules[f"ratio_outside {name}"] = F.isnan(x) | ~x.between(0.0, 1.0)
        if n.endswith("_count"):
            rules[f"count_negative {name}"] = (x < 0) if isinstance(kind, (T.LongType, T.IntegerType)) else x.isNotNull()
        if isinstance(kind, T.StringType):
            rules[f"absolute_path {name}"] = absolute_path(x)
    return rules


def dataset_findings(manifest: DataFrame, records: DataFrame, order: str = "entry_id", key: str = "sample_id") -> DataFrame:
    """(order, rule) of every rule that a manifest line breaks, by itself or against its record.

    records: key, video_sha256, expected_label, errors (how many rules of its own a record breaks), one row per key.
    """
    first = manifest.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    rows = manifest.join(first, key, "left").join(records.select(key, F.col("video_sha256").alias("_sha"), F.col("expected_label").alias("_label"), F.col("errors").alias("_errors"), F.lit(True).alias("_there")), key, "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    there, unlike = F.coalesce("_there", F.lit(False)), lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    readable = ~blank("feature_file") & ~unsafe_path(F.col("feature_file"))
    rules = {
        "sample_id missing": blank(key), "sample_id repeated": F.col("_first") < F.col(order), "label invalid": ~F.coalesce(F.col("expected_label").isin(*LABELS), F.lit(False)),
        "feature_file missing": blank("feature_file"), "feature_file unsafe": ~blank("feature_file") & unsafe_path(F.col("feature_file")), "record missing": readable & ~there,
        "digest differs": readable & there & unlike("video_sha256", "_sha"), "label differs": readable & there & unlike("expected_label", "_label"), "record invalid": readable & there & (F.col("_errors") > 0),
    }
    return rows.select(order, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))).alias("rule"))


def dataset_state(manifest: DataFrame, findings: DataFrame, order: str = "entry_id") -> DataFrame:
    """One row: lines, valid and invalid ones, repeated digests, and the status."""
    bad = findings.select(order).distinct().agg(F.count(F.lit(1)).alias("invalid"))
    lines = manifest.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.coalesce("video_sha256", F.lit("")) != "").alias("_digests"))
    distinct = manifest.filter("video_sha256 <> ''").select("video_sha256").distinct().agg(F.count(F.lit(1)).alias("_distinct"))
    one = lines.crossJoin(F.broadcast(bad)).crossJoin(F.broadcast(distinct))  # one row each
    repeated = F.col("_digests") - F.col("_distinct")
    return one.select("lines", (F.col("lines") - F.col("invalid")).alias("valid"), "invalid", repeated.alias("repeated_digests"), F.when((F.col("invalid") > 0) | (repeated > 0), "invalid").otherwise("valid").alias("status"))


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, column_name, missing of every column: one aggregate, unpivoted after it."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)))
    return counts.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)))))
