"""Queries of column profiles, registries, records and source metadata over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.functions.text import digest_hex, trimmed_lower
from reelgrain.operators import audit, columns, records, registry, sourcing
from reelgrain.operators import validation as va
from reelgrain.session import small_rows, table

#: The leaves of a feature record by group, with their types (b flag, d measure, l count, s text).
LEAVES = {
    "identity": "feature_schema_version s, application_version s, analysis_id s, video_name s, video_sha256 s, expected_label s",
    "media": "duration_seconds d, width l, height l, frame_rate d, frame_count l, audio_present b",
    "metadata_indicators": "creation_time_present b, encoder_metadata_present b, duration_metadata_consistent b",
    "frame_summary": "sampled_frame_count l, mean_brightness d, mean_contrast d, mean_sharpness d, dark_frame_ratio d, white_frame_ratio d",
    "temporal_summary": "analyzed_transition_count l, notable_transition_count l, scene_boundary_count l, near_static_interval_count l, mean_normalized_frame_difference d, maximum_normalized_frame_difference d, mean_flow_warp_residual d, maximum_flow_warp_residual d, mean_motion_magnitude d, maximum_motion_magnitude d",
    "audio_summary": "audio_window_count l, ranked_audio_transition_count l, silence_interval_count l, clipping_interval_count l, maximum_audio_energy_change d, mean_audio_rms d",
    "visual_consistency_summary": "analyzed_region_record_count l, ranked_consistency_transition_count l, sustained_instability_interval_count l, maximum_unstable_region_count l, maximum_edge_instability d, maximum_texture_distance d, maximum_detail_residual d",
    "unified_evidence_summary": "timeline_event_count l, high_priority_event_count l, moderate_priority_event_count l, cross_modal_event_count l, maximum_independent_evidence_group_count l",
    "d3_summary": "d3_status s, d3_raw_score d, d3_encoder s, d3_distance_mode s, d3_selected_frame_count l, d3_first_order_value_count l, d3_second_order_value_count l, d3_second_order_mean d, d3_second_order_standard_deviation d, d3_calibration_status s, d3_score_direction s",
}
TYPES = {f"{g}.{n}": k for g, fields in LEAVES.items() for n, k in (f.split() for f in fields.split(", "))}
NUMBERS = sorted(c for c, k in TYPES.items() if k in "dl")
#: The numeric names of schema 0.10.0; i integer, d float; two of them are in no record.
STANDARD = {
    "audio_summary.audio_window_count": "d", "audio_summary.mean_audio_rms": "d", "d3_summary.d3_raw_score": "d", "frame_summary.dark_frame_ratio": "d", "frame_summary.mean_brightness": "d", "frame_summary.mean_contrast": "d",
    "frame_summary.mean_sharpness": "d", "frame_summary.sampled_frame_count": "i", "frame_summary.white_frame_ratio": "d", "media.duration_seconds": "d", "media.frame_count": "i", "media.frame_rate": "d", "media.height": "i", "media.width": "i",
    "temporal_summary.flicker_index": "d", "temporal_summary.maximum_motion_magnitude": "d", "temporal_summary.mean_motion_magnitude": "d", "temporal_summary.notable_transition_count": "i", "unified_evidence_summary.timeline_event_count": "i",
    "visual_consistency_summary.legacy_grid_score": "d", "visual_consistency_summary.maximum_edge_instability": "d",
}
TARGET, LABEL = "expected_label", "identity.expected_label"
AUDITED = (*sorted(TYPES), "sample_id", TARGET)


def flat(s: SparkSession, d: str) -> DataFrame:
    """A row per record, all leaves by dotted name, with the target beside them."""
    rows = audit.flatten(table(s, d, "outcome_features").dropDuplicates(["record_id"]), keep=("record_id", "run_id", "load_no", "sample_id"))
    return rows.withColumn(TARGET, F.col(f"`{LABEL}`"))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles that depend on the order of a sum, without their last digits."""
    return df.select(*(F.bround(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    return columns.full_audit(flat(s, d), AUDITED, TARGET)


def _show(df: DataFrame) -> DataFrame:
    return df.withColumn("flags", F.array_join("flags", "|")) if "flags" in df.columns else df


def _features(s: SparkSession, d: str, version: str = "0.10.0") -> list[registry.Feature]:
    return registry.from_schema_table(small_rows(table(s, d, "feature_schema").filter(F.col("feature_schema_version") == version)), version)


def _standardised(s: SparkSession, d: str) -> DataFrame:
    features = _features(s, d)
    made = registry.standardised(flat(s, d), features, registry.schema_document(features, "0.10.0"), "record_id", TARGET)
    return made.select(F.col("sample.sample_id").cast("bigint").alias("record_id"), F.col("sample.label").alias("label"), *(F.col(f"features.`{f.export_name}`").alias(f.export_name.replace(".", "_")) for f in features if f.model_candidate))


def _column_findings(s: SparkSession, d: str) -> DataFrame:
    found = registry.column_findings([c for c in flat(s, d).columns if c in TYPES], _features(s, d))
    return s.createDataFrame(found, "severity string, column_name string, finding string")


def _derived(s: SparkSession, d: str) -> DataFrame:
    made = registry.derived(flat(s, d), registry.derived_registry())
    return made.select("record_id", *(F.col(f"`{n}`").alias(n.removeprefix("derived.")) for n, _, _ in registry.DERIVED), "missing_dependencies")


def _record_violations(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "outcome_features").dropDuplicates(["record_id"])
    return va.violations(rows, ["record_id"], records.record_rules(rows))


def _dataset(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "outcome_features").dropDuplicates(["record_id"])
    latest = rows.groupBy("sample_id").agg(F.max_by(F.struct("*"), F.struct("loaded_at", "record_id")).alias("r")).select("r.*")
    rules = records.record_rules(latest)
    errors = F.size(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(1)) for c in rules.values()))))
    held = latest.select("sample_id", F.col("identity.video_sha256").alias("video_sha256"), F.col(LABEL).alias(TARGET), errors.alias("errors"))
    manifest = table(s, d, "manifest").withColumns({"video_sha256": digest_hex("video_sha256"), TARGET: trimmed_lower(TARGET)})
    return manifest, records.dataset_findings(manifest, held)


def _dataset_state(s: SparkSession, d: str) -> DataFrame:
    manifest, found = _dataset(s, d)
    return records.dataset_state(manifest, found)


def _summary(s: SparkSession, d: str) -> DataFrame:
    f, status = flat(s, d), F.col("`d3_summary.d3_status`")
    known = F.when(status.isin("completed", "failed", "unavailable"), status).otherwise("missing")
    return f.groupBy("run_id", "load_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(TARGET) == "real").alias("real"), F.count_if(F.col(TARGET) == "ai_generated").alias("ai_generated"), (F.count("`identity.video_sha256`") - F.count_distinct("`identity.video_sha256`")).alias("repeated_digests"),
        F.array_join(F.array_sort(F.collect_set("`identity.feature_schema_version`")), ",").alias("versions"), *(F.count_if(known == x).alias(f"d3_{x}") for x in ("completed", "failed", "unavailable", "missing")),
    )


def _listing(s: SparkSession, d: str) -> DataFrame:
    """The files that the manifest knows, as a listing."""
    return table(s, d, "manifest").filter("video_name is not null").select(F.concat(F.lit("videos/"), "video_name").alias("path")).distinct()


def _plan(s: SparkSession, d: str) -> DataFrame:
    rows = sourcing.normalised(table(s, d, "source_metadata_raw")).drop("cells")
    return sourcing.plan(sourcing.availability(rows, _listing(s, d)), {"real": 50, "ai_generated": 50})


def _reports(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "report_raw").dropDuplicates(["report_id", "body"])
    made = records.feature_record(rows)
    return audit.flatten(made, keep=("report_id",))


QUERIES = {
    "agg13_profiles": lambda s, d: _show(_profiles(s, d)),
    "flt08_categories": lambda s, d: _profiles(s, d).groupBy("category", "detected_type").agg(F.count(F.lit(1)).alias("columns")),
    "flt09_quality": lambda s, d: _profiles(s, d).select("column_name", "status", "eligible"),
    "sec01_missing": lambda s, d: columns.missing_table(_profiles(s, d)),
    "sec02_invalid": lambda s, d: columns.invalid_cells(flat(s, d), AUDITED, TARGET, "record_id"),
    "sec03_constant": lambda s, d: columns.constant_table(_profiles(s, d)),
    "der04_model_schema": lambda s, d: columns.model_schema(_profiles(s, d)),
    "agg21_readiness": lambda s, d: columns.readiness(flat(s, d), _profiles(s, d), TARGET, ("sample_id", "identity.video_sha256")),
    "agg18_correlations": lambda s, d: audit.correlations(flat(s, d), NUMBERS).withColumn("r", F.round("r", 8)),
    "agg18_high_pairs": lambda s, d: audit.correlations(flat(s, d), NUMBERS, 0.6).withColumn("r", F.round("r", 8)),
    "val06_findings": lambda s, d: registry.value_findings(flat(s, d), "record_id", _features(s, d)),
    "jon15_columns": _column_findings,
    "prj07_standardised": _standardised,
    "sec07_preparation": lambda s, d: registry.preparation_profile(flat(s, d).select("record_id", *(f"`{c}`" for c in sorted(TYPES))), [*_features(s, d), *(f for f in registry.derived_registry() if f.export_name not in {x.export_name for x in _features(s, d)})], "record_id", "0.10.0"),
    "der01_derived": _derived,
    "val02_record_rules": _record_violations,
    "val03_dataset_rules": lambda s, d: _dataset(s, d)[1],
    "val03_dataset_state": _dataset_state,
    "agg22_summary": _summary,
    "agg22_nulls": lambda s, d: records.null_counts(flat(s, d), sorted(TYPES), ["run_id", "load_no"]).filter("missing > 0"),
    "prj02_rows": lambda s, d: records.with_manifest(flat(s, d), table(s, d, "manifest")).select("record_id", "sample_id", TARGET, "feature_file", "source", "generator_or_camera", "notes", "added_at", F.col("`media.width`").alias("width")),
    "prj04_records": lambda s, d: _reports(s, d).withColumnsRenamed({c: c.replace(".", "_") for c in TYPES}),
    "prj06_normalised": lambda s, d: sourcing.normalised(table(s, d, "source_metadata_raw")).drop("cells"),
    "agg23_source_audit": lambda s, d: sourcing.audit(table(s, d, "source_metadata_raw"), _listing(s, d)),
    "agg23_columns": lambda s, d: sourcing.column_audit(table(s, d, "source_metadata_raw")),
    "win20_plan": _plan,
    "agg29_impossible": lambda s, d: columns.cells(flat(s, d), NUMBERS, TARGET).withColumn("rule", columns.impossible(F.col("column_name"), F.col("number"))).filter("rule is not null").groupBy("column_name", "rule").agg(F.count(F.lit(1)).alias("n")),
    "prj01_flat": lambda s, d: flat(s, d).select("record_id", *((audit.finite(F.col(f"`{c}`")) if k == "d" else F.col(f"`{c}`")).alias(c.replace(".", "_")) for c, k in sorted(TYPES.items()))),
    "agg14_describe": lambda s, d: rounded(audit.describe(flat(s, d), NUMBERS, TARGET)),
    "agg15_compare_classes": lambda s, d: rounded(audit.compare_classes(flat(s, d), NUMBERS, TARGET, "real", "ai_generated").drop("p")),
    "agg16_rank_test": lambda s, d: rounded(audit.rank_test(flat(s, d), NUMBERS, TARGET, "real", "ai_generated")),
    "agg16_p_values": lambda s, d: audit.compare_classes(flat(s, d), NUMBERS, TARGET, "real", "ai_generated").select("column_name", (F.col("p") < 0.05).alias("p_below_0_05")),
    "val07_plan_rules": lambda s, d: sourcing.plan_findings(_plan(s, d).withColumns({"line_no": F.col("plan_index"), "source_dataset": F.lit("collected"), "metadata_source_file": F.col("file_name")}), _listing(s, d)),
}

_F = "f AS (SELECT *, identity.expected_label AS label FROM outcome_features QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_MISS = "('', 'null', 'none', 'nan', 'na', 'n/a')"
_NUM = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"


def _cell(c: str, kind: str, at: str) -> str:
    if kind == "d":
        return f"SELECT record_id, label, '{c}' AS column_name, CASE WHEN NOT isnan({at}) THEN {at} END AS number, NULL AS text, CASE WHEN {at} IS NULL OR isnan({at}) THEN 'missing' WHEN isinf({at}) THEN 'invalid' ELSE 'numeric' END AS state FROM f"
    if kind == "l":
        return f"SELECT record_id, label, '{c}', CAST({at} AS DOUBLE), NULL, CASE WHEN {at} IS NULL THEN 'missing' ELSE 'numeric' END FROM f"
    if kind == "b":
        return f"SELECT record_id, label, '{c}', NULL, CASE WHEN {at} THEN 'True' WHEN NOT {at} THEN 'False' END, CASE WHEN {at} IS NULL THEN 'missing' ELSE 'other' END FROM f"
    low = f"lower(trim({at}))"
    state = f"CASE WHEN {at} IS NULL OR {low} IN {_MISS} THEN 'missing' WHEN regexp_full_match(trim({at}), {_NUM}) THEN 'numeric' WHEN {low} IN ('true', 'false') THEN 'other' WHEN regexp_matches({at}, '[0-9]') OR {low} IN ('inf', '-inf', 'infinity', '-infinity', '+inf') THEN 'invalid' ELSE 'other' END"
    return f"SELECT record_id, label, '{c}', CASE WHEN regexp_full_match(trim({at}), {_NUM}) THEN CAST(trim({at}) AS DOUBLE) END, CASE WHEN {at} IS NOT NULL AND {low} NOT IN {_MISS} THEN {at} END, {state} FROM f"


_U = "u AS (" + " UNION ALL ".join([_cell(c, TYPES[c], c) for c in sorted(NUMBERS, key=lambda c: TYPES[c])] + [_cell(c, k, c) for c, k in sorted(TYPES.items()) if k not in "dl"] + [_cell("sample_id", "s", "sample_id"), _cell(TARGET, "s", LABEL)]) + ")"
_TERMS = "('ai'), ('ai_generated'), ('deepfake'), ('external'), ('fake'), ('generated'), ('kaggle'), ('manual_source'), ('personal'), ('real'), ('self_recorded')"
_BAD = "CASE WHEN regexp_matches(lower(column_name), '(^|[^a-z0-9])(duration|width|height|count|sample)([^a-z0-9]|$)') AND number < 0 THEN 'negative' WHEN regexp_matches(lower(column_name), '(^|[^a-z0-9])(ratio|percentage)([^a-z0-9]|$)') AND (number < 0 OR number > 1) THEN 'outside_share' END"
_P = f"""{_F}, {_U}, k AS (SELECT column_name, state, number, text, count(*) AS n, count(*) FILTER (label = 'real') AS nr, count(*) FILTER (label = 'ai_generated') AS na, {_BAD} AS bad FROM u GROUP BY 1, 2, 3, 4),
p0 AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (state <> 'missing'), 0) AS BIGINT) AS present, CAST(coalesce(sum(n) FILTER (state = 'missing'), 0) AS BIGINT) AS missing, CAST(coalesce(sum(nr) FILTER (state = 'missing'), 0) AS BIGINT) AS missing_real, CAST(coalesce(sum(na) FILTER (state = 'missing'), 0) AS BIGINT) AS missing_ai_generated,
count(*) FILTER (state <> 'missing') AS distinct_values, coalesce(sum(n) FILTER (state = 'numeric'), 0) AS num, CAST(coalesce(sum(n) FILTER (state = 'invalid'), 0) AS BIGINT) AS inv, CAST(coalesce(sum(n) FILTER (bad IS NOT NULL), 0) AS BIGINT) AS odd, bool_and(coalesce(lower(text), '') IN ('true', 'false')) FILTER (state <> 'missing') AS flag,
first({{'n': n, 'number': number, 'text': text}} ORDER BY n DESC, coalesce(number, '-infinity'::DOUBLE), text) FILTER (state <> 'missing') AS mode FROM k GROUP BY 1),
p1 AS (SELECT *, CASE WHEN present = 0 THEN 'empty' WHEN flag THEN 'boolean' WHEN num = present THEN 'numeric' WHEN num > 0 AND inv > 0 THEN 'mixed_numeric' ELSE 'categorical' END AS detected_type, lower(column_name) AS low FROM p0),
p2 AS (SELECT *, CASE WHEN detected_type = 'empty' THEN 'fully_empty' WHEN column_name = 'expected_label' THEN 'target' WHEN low LIKE '%label%' OR low LIKE '%verdict%' OR low LIKE '%classification%' THEN 'possible_leakage'
WHEN low LIKE '%path%' OR low LIKE '%file%' OR contains(low, 'video_name') OR ends_with(low, '.name') OR ends_with(low, '_name') THEN 'path' WHEN low = 'sample_id' OR ends_with(low, 'sha256') OR ends_with(low, '.analysis_id') THEN 'identifier'
WHEN ends_with(low, '_at') OR low LIKE '%timestamp%' OR contains(low, 'creation_time') THEN 'timestamp' WHEN low IN ('source', 'notes') OR low LIKE '%generator%' OR low LIKE '%camera%' THEN 'source_metadata'
WHEN contains(low, 'schema_version') OR contains(low, 'application_version') OR starts_with(low, 'd3_summary.d3_encoder') OR starts_with(low, 'd3_summary.d3_distance') OR low LIKE '%calibration%' OR contains(low, 'score_direction') OR ends_with(low, '.d3_status') THEN 'analysis_metadata'
WHEN detected_type IN ('numeric', 'mixed_numeric') THEN 'numeric_feature' WHEN detected_type IN ('boolean', 'categorical') THEN 'categorical_feature' ELSE 'unsupported' END AS cat0, CASE WHEN detected_type IN ('numeric', 'mixed_numeric') THEN inv + odd ELSE 0 END AS invalid_numeric, distinct_values = 1 AND present > 0 AS cst FROM p1),
held AS (SELECT DISTINCT column_name FROM (SELECT column_name, lower(coalesce(text, CAST(number AS VARCHAR))) AS v FROM k WHERE state <> 'missing') JOIN (VALUES {_TERMS}) t(term) ON contains(v, term)),
leak AS (SELECT column_name FROM p2 WHERE column_name <> 'expected_label' AND (low LIKE '%label%' OR low = 'sample_id' OR contains(low, 'video_name') OR low LIKE '%file%' OR low LIKE '%path%' OR low IN ('source', 'notes') OR low LIKE '%generator%' OR column_name IN (FROM held))),
p3 AS (SELECT *, CASE WHEN column_name IN (FROM leak) AND cat0 <> 'target' THEN 'possible_leakage' ELSE cat0 END AS category,
list_sort(list_filter([CASE WHEN cst THEN 'constant' END, CASE WHEN present = 0 THEN 'fully_empty' END, CASE WHEN detected_type IN ('numeric', 'mixed_numeric') AND odd > 0 OR cat0 = 'numeric_feature' AND inv > 0 THEN 'invalid_numeric' END, CASE WHEN missing / rows > 0.4 THEN 'missing_heavy' END, CASE WHEN NOT cst AND mode.n / present >= 0.95 THEN 'near_constant' END, CASE WHEN column_name IN (FROM leak) AND cat0 <> 'target' THEN 'possible_leakage' END], lambda x: x IS NOT NULL)) AS fl FROM p2),
p4 AS (SELECT *, CASE WHEN category = 'target' THEN 'target' WHEN category IN ('source_metadata', 'analysis_metadata') THEN 'metadata_only' WHEN category IN ('identifier', 'path', 'timestamp', 'possible_leakage', 'unsupported', 'fully_empty') THEN category
WHEN list_contains(fl, 'invalid_numeric') THEN 'invalid_numeric' WHEN list_contains(fl, 'constant') THEN 'constant' WHEN list_contains(fl, 'near_constant') THEN 'near_constant' WHEN list_contains(fl, 'missing_heavy') THEN 'missing_heavy' WHEN category = 'numeric_feature' THEN 'candidate' ELSE 'review_required' END AS status FROM p3),
p AS (SELECT column_name, category, detected_type, rows, present, missing, missing / rows AS missing_share, missing_real, missing_ai_generated, distinct_values, invalid_numeric, mode.number AS mode_number, mode.text AS mode_text, CAST(mode.n AS BIGINT) AS dominant, mode.n / present AS dominant_share, array_to_string(fl, '|') AS flags, status, status = 'candidate' AS eligible,
CASE WHEN status = 'candidate' THEN NULL WHEN category = 'target' THEN 'target column' WHEN category IN ('identifier', 'path', 'timestamp', 'source_metadata', 'analysis_metadata', 'possible_leakage', 'unsupported', 'fully_empty') THEN 'category ' || category WHEN status = 'review_required' THEN 'no encoding' ELSE status END AS reason FROM p4)"""
_FIN = "CASE WHEN NOT isnan(CAST({0} AS DOUBLE)) AND NOT isinf(CAST({0} AS DOUBLE)) THEN CAST({0} AS DOUBLE) END"
_V = "v AS (" + " UNION ALL ".join(f"SELECT record_id, '{c}' AS column_name, {_FIN.format(c)} AS value FROM f" for c in NUMBERS) + ")"
_VL = "v AS (" + " UNION ALL ".join(f"SELECT label, '{c}' AS column_name, {_FIN.format(c)} AS value FROM f" for c in NUMBERS) + ")"
_STAT = "count(value) AS n, count(*) - count(value) AS missing, round_even(avg(value), 8) AS mean, median(value) AS median, round_even(stddev_pop(value), 8) AS deviation, min(value) AS low, max(value) AS high, round_even(quantile_cont(value, 0.25), 8) AS q1, round_even(quantile_cont(value, 0.75), 8) AS q3, count(DISTINCT value) AS distinct_values, round_even(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) AS iqr"
_R = f"WITH {_F}, {_V}, r AS (SELECT a.column_name AS left_column, b.column_name AS right_column, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value), 0) / nullif(stddev_pop(b.value), 0), 8) END AS r FROM v a JOIN v b ON a.record_id = b.record_id AND a.column_name < b.column_name WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2)"
_SCHEMA = "(SELECT * FROM feature_schema WHERE feature_schema_version = '0.10.0')"
_REGISTERED = f"WITH {_F}, {_U}, t AS (SELECT u.*, s.data_type, s.minimum, s.maximum FROM u JOIN {_SCHEMA} s ON s.export_name = u.column_name)"
_TYPED = "CASE WHEN data_type = 'float' THEN state = 'numeric' WHEN data_type = 'integer' THEN state = 'numeric' AND number = floor(number) WHEN data_type = 'boolean' THEN lower(text) IN ('true', 'false') ELSE text IS NOT NULL OR number IS NOT NULL END"
_D = {n: parts for n, _, parts in registry.DERIVED}
_absent = lambda c: f"({c} IS NULL" + (f" OR isnan({c}))" if TYPES[c] == "d" else ")")
_ratio = lambda a, b: f"({_FIN.format(a)}) / nullif({_FIN.format(b)}, 0)"
_DIG = "CASE WHEN regexp_full_match(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '^(sha-?256[:=]\\s*|0x)', ''), '[0-9a-f]{{64}}') THEN regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '^(sha-?256[:=]\\s*|0x)', '') END"
_RULES = (
    [("label_invalid", f"coalesce({LABEL} NOT IN ('real', 'ai_generated'), true)"), ("score_calibrated", "d3_summary.d3_raw_score IS NOT NULL AND coalesce(d3_summary.d3_calibration_status <> 'uncalibrated', true)")]
    + [(f"not_finite {c}", f"isnan({c}) OR isinf({c})") for c, k in TYPES.items() if k == "d"]
    + [(f"ratio_outside {c}", f"isnan({c}) OR NOT {c} BETWEEN 0 AND 1") for c in ("frame_summary.dark_frame_ratio", "frame_summary.white_frame_ratio")]
    + [(f"count_negative {c}", f"{c} < 0") for c in TYPES if c.endswith("_count")]
    + [(f"absolute_path {c}", f"regexp_matches({c}, '^[A-Za-z]:[\\\\/]|^[/\\\\]')") for c, k in TYPES.items() if k == "s"]
)
_UNSAFE = "regexp_matches({0}, '^[A-Za-z]:[\\\\/]|^[/\\\\]|(^|[/\\\\])\\.\\.([/\\\\]|$)')"
_DS = f"""l AS (SELECT * FROM (SELECT *, identity.expected_label AS label FROM outcome_features QUALIFY row_number() OVER (PARTITION BY record_id) = 1) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY loaded_at DESC, record_id DESC) = 1),
e AS (SELECT sample_id, identity.video_sha256 AS sha, label, {' + '.join(f'CAST(coalesce({c}, false) AS INT)' for _, c in _RULES)} AS errors FROM l),
m AS (SELECT * EXCLUDE (video_sha256, expected_label), {_DIG.format('video_sha256')} AS video_sha256, lower(trim(expected_label, ' ' || chr(9) || chr(10) || chr(13))) AS expected_label, min(entry_id) OVER (PARTITION BY sample_id) AS f0 FROM manifest),
j AS (SELECT m.*, e.sample_id IS NOT NULL AS there, sha, label, errors, coalesce(feature_file, '') <> '' AND NOT {_UNSAFE.format('feature_file')} AS readable FROM m LEFT JOIN e USING (sample_id)),
w AS (SELECT entry_id, 'sample_id missing' AS rule FROM j WHERE coalesce(sample_id, '') = '' UNION ALL SELECT entry_id, 'sample_id repeated' FROM j WHERE sample_id IS NOT NULL AND f0 < entry_id UNION ALL SELECT entry_id, 'label invalid' FROM j WHERE coalesce(expected_label, '') NOT IN ('real', 'ai_generated')
UNION ALL SELECT entry_id, 'feature_file missing' FROM j WHERE coalesce(feature_file, '') = '' UNION ALL SELECT entry_id, 'feature_file unsafe' FROM j WHERE coalesce(feature_file, '') <> '' AND NOT readable UNION ALL SELECT entry_id, 'record missing' FROM j WHERE readable AND NOT there
UNION ALL SELECT entry_id, 'digest differs' FROM j WHERE readable AND there AND video_sha256 IS DISTINCT FROM sha UNION ALL SELECT entry_id, 'label differs' FROM j WHERE readable AND there AND expected_label IS DISTINCT FROM label UNION ALL SELECT entry_id, 'record invalid' FROM j WHERE readable AND there AND errors > 0)"""

ORACLES = {
    "agg13_profiles": f"WITH {_P} FROM p",
    "flt08_categories": f"WITH {_P} SELECT category, detected_type, count(*) AS columns FROM p GROUP BY 1, 2",
    "flt09_quality": f"WITH {_P} SELECT column_name, status, eligible FROM p",
    "sec01_missing": f"WITH {_P} SELECT column_name, missing, missing_share, present, present = 0 AS fully_empty, missing_real, missing_ai_generated, missing_real <> missing_ai_generated AS differs_by_class, CASE WHEN starts_with(column_name, 'audio_summary.') THEN 'absence and failure cannot be told apart' WHEN present = 0 THEN 'fully empty' ELSE 'review' END AS interpretation FROM p WHERE missing > 0",
    "sec02_invalid": f"WITH {_F}, {_U}, b AS (SELECT column_name, record_id AS key, number, text, CASE WHEN state = 'invalid' THEN CASE WHEN text IS NULL THEN 'not finite' ELSE 'mixed text' END ELSE {_BAD} END AS reason FROM u) SELECT * FROM b WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY key, reason) <= 10",
    "sec03_constant": f"WITH {_P} SELECT column_name, distinct_values, dominant, dominant_share, contains('|' || flags || '|', '|constant|') AS constant, contains(flags, 'near_constant') AS near_constant FROM p WHERE regexp_matches(flags, '(^|\\|)constant|near_constant|fully_empty')",
    "der04_model_schema": f"WITH {_P} SELECT column_name, CASE WHEN eligible AND regexp_matches(lower(column_name), 'label|path|file|video_name|sample_id|sha256|hash') THEN 'forbidden' WHEN eligible THEN 'included' ELSE 'excluded' END AS role, reason AS exclusion_reason, category, detected_type, missing, missing_share, status, flags FROM p WHERE category <> 'target'",
    "agg21_readiness": f"""WITH {_P}, z AS (SELECT count(*) AS rows, count(*) FILTER (label = 'real') AS real, count(*) FILTER (label = 'ai_generated') AS ai_generated, count(sample_id) - count(DISTINCT sample_id) + count(CASE WHEN lower(trim(identity.video_sha256)) NOT IN {_MISS} THEN 1 END) - count(DISTINCT CASE WHEN lower(trim(identity.video_sha256)) NOT IN {_MISS} THEN identity.video_sha256 END) AS duplicates FROM f),
q AS (SELECT CAST(sum(invalid_numeric) AS BIGINT) AS invalid_numeric, count(*) FILTER (eligible) AS candidates FROM p)
SELECT *, CASE WHEN rows < 100 OR least(real, ai_generated) < 50 THEN 'insufficient_dataset_size' WHEN least(real, ai_generated) = 0 OR duplicates > 0 OR invalid_numeric > 0 OR candidates = 0 THEN 'requires_cleanup' WHEN rows < 500 THEN 'audit_passed_for_experimentation' ELSE 'ready_for_baseline_experiment' END AS decision FROM z, q""",
    "agg18_correlations": f"{_R} FROM r",
    "agg18_high_pairs": f"{_R} FROM r WHERE abs(r) >= 0.6",
    "val06_findings": f"{_REGISTERED} SELECT record_id, column_name, CASE WHEN NOT coalesce({_TYPED}, false) THEN 'invalid_type' ELSE 'out_of_range' END AS finding FROM t WHERE state <> 'missing' AND (NOT coalesce({_TYPED}, false) OR data_type IN ('integer', 'float') AND (number < minimum OR number > maximum))",
    "jon15_columns": f"SELECT 'warning' AS severity, c AS column_name, 'unregistered' AS finding FROM (SELECT UNNEST([{', '.join(repr(c) for c in sorted(TYPES))}]) AS c) WHERE c NOT IN (SELECT export_name FROM {_SCHEMA})",
    "prj07_standardised": f"WITH {_F} SELECT record_id, label, " + ", ".join((f"CAST(NULL AS DOUBLE)" if c not in TYPES else _FIN.format(c) if k == "d" else c) + f" AS {c.replace('.', '_')}" for c, k in STANDARD.items()) + " FROM f",
    "der01_derived": f"""WITH {_F} SELECT record_id, ({_FIN.format('frame_summary.dark_frame_ratio')}) + ({_FIN.format('frame_summary.white_frame_ratio')}) AS exposure_extreme_ratio, {_ratio('frame_summary.mean_sharpness', 'frame_summary.mean_contrast')} AS sharpness_contrast_ratio,
{_ratio('temporal_summary.maximum_motion_magnitude', 'temporal_summary.mean_motion_magnitude')} AS motion_spike_ratio, {_ratio('temporal_summary.maximum_flow_warp_residual', 'temporal_summary.mean_flow_warp_residual')} AS flow_residual_ratio, CAST(coalesce(audio_summary.audio_window_count, 0) <> 0 AS DOUBLE) AS audio_features_available,
(CAST(coalesce(frame_summary.sampled_frame_count, 0) > 0 AS INT) + CAST(coalesce(temporal_summary.analyzed_transition_count, 0) > 0 AS INT) + CAST(coalesce(audio_summary.audio_window_count, 0) > 0 AS INT) + CAST(coalesce(visual_consistency_summary.analyzed_region_record_count, 0) > 0 AS INT) + CAST(coalesce(d3_summary.d3_status = 'completed', false) AS INT)) / 5.0 AS evidence_module_coverage,
{' + '.join(f'CAST({_absent(c)} AS INT)' for parts in _D.values() for c in parts)} AS missing_dependencies FROM f""",
    "val02_record_rules": f"WITH {_F} " + " UNION ALL ".join(f"SELECT record_id, '{n}' AS rule FROM f WHERE {c}" for n, c in _RULES),
    "val03_dataset_rules": f"WITH {_DS} FROM w",
    "val03_dataset_state": f"WITH {_DS} SELECT count(*) AS lines, count(*) - (SELECT count(DISTINCT entry_id) FROM w) AS valid, (SELECT count(DISTINCT entry_id) FROM w) AS invalid, count(video_sha256) - count(DISTINCT video_sha256) AS repeated_digests, 'invalid' AS status FROM m",
    "agg22_summary": f"WITH {_F} SELECT run_id, load_no, count(*) AS n, count(*) FILTER (label = 'real') AS real, count(*) FILTER (label = 'ai_generated') AS ai_generated, count(identity.video_sha256) - count(DISTINCT identity.video_sha256) AS repeated_digests, array_to_string(list_sort(list(DISTINCT identity.feature_schema_version) FILTER (identity.feature_schema_version IS NOT NULL)), ',') AS versions, count(*) FILTER (d3_summary.d3_status = 'completed') AS d3_completed, count(*) FILTER (d3_summary.d3_status = 'failed') AS d3_failed, count(*) FILTER (d3_summary.d3_status = 'unavailable') AS d3_unavailable, count(*) FILTER (coalesce(d3_summary.d3_status, '') NOT IN ('completed', 'failed', 'unavailable')) AS d3_missing FROM f GROUP BY 1, 2",
    "agg22_nulls": f"WITH {_F}, x AS (" + " UNION ALL ".join(f"SELECT run_id, load_no, '{c}' AS column_name, count(*) - count({c}) AS missing FROM f GROUP BY 1, 2" for c in sorted(TYPES)) + ") FROM x WHERE missing > 0",
    "prj02_rows": f"WITH {_F} SELECT record_id, f.sample_id, m.expected_label, m.feature_file, m.source, m.generator_or_camera, m.notes, m.added_at, f.media.width AS width FROM f JOIN manifest m ON m.sample_id = f.sample_id",
    "agg29_impossible": f"WITH {_F}, {_U}, b AS (SELECT column_name, {_BAD} AS rule FROM u WHERE column_name IN ({', '.join(repr(c) for c in NUMBERS)})) SELECT column_name, rule, count(*) AS n FROM b WHERE rule IS NOT NULL GROUP BY 1, 2",
    "prj01_flat": f"WITH {_F} SELECT record_id, " + ", ".join(f"{_FIN.format(c) if k == 'd' else c} AS {c.replace('.', '_')}" for c, k in sorted(TYPES.items())) + " FROM f",
    "agg14_describe": f"WITH {_F}, {_VL} SELECT column_name, '*' AS class, {_STAT} FROM v GROUP BY 1 UNION ALL SELECT column_name, coalesce(label, '?'), {_STAT} FROM v GROUP BY 1, 2",
    "agg15_compare_classes": f"""WITH {_F}, {_VL}, s AS (SELECT column_name, label, count(value) AS n, avg(value) AS m, median(value) AS med, var_pop(value) AS va, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1, 2),
w AS (SELECT column_name, covar_pop(value, CAST(label = 'ai_generated' AS INT)) / nullif(stddev_pop(value), 0) / nullif(stddev_pop(CAST(label = 'ai_generated' AS INT)), 0) AS pb FROM v WHERE value IS NOT NULL AND label IN ('real', 'ai_generated') GROUP BY 1),
k AS (SELECT *, rank() OVER (PARTITION BY column_name ORDER BY value) + (count(*) OVER (PARTITION BY column_name, value) - 1) / 2 AS r FROM v WHERE value IS NOT NULL AND label IN ('real', 'ai_generated')),
t AS (SELECT column_name, sum(r) FILTER (label = 'real') AS r1, count(*) FILTER (label = 'real') AS n1, count(*) FILTER (label <> 'real') AS n2 FROM k GROUP BY 1),
z AS (SELECT column_name, CASE WHEN n1 >= 2 AND n2 >= 2 THEN (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) END AS z FROM t),
p AS (SELECT c.column_name, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, a.m AS m1, b.m AS m2, a.med AS d1, b.med AS d2, CASE WHEN a.n >= 2 AND b.n >= 2 THEN sqrt(((a.n - 1) * a.va + (b.n - 1) * b.va) / (a.n + b.n - 2)) END AS pooled, a.hi < b.lo OR b.hi < a.lo AS apart FROM (SELECT DISTINCT column_name FROM v) c LEFT JOIN s a ON a.column_name = c.column_name AND a.label = 'real' LEFT JOIN s b ON b.column_name = c.column_name AND b.label = 'ai_generated')
SELECT column_name, n1, n2, {', '.join(f'CASE WHEN n1 > 0 AND n2 > 0 THEN round_even({x}, 8) END AS {n}' for x, n in (('m1', 'mean1'), ('m2', 'mean2'), ('m2 - m1', 'mean_difference'), ('abs(m2 - m1)', 'absolute_difference'), ('d1', 'median1'), ('d2', 'median2'), ('d2 - d1', 'median_difference'), ('pooled', 'pooled_deviation'), ('(m2 - m1) / nullif(pooled, 0)', 'effect'), ('pb', 'point_biserial')))},
CASE WHEN n1 = 0 OR n2 = 0 THEN 'unavailable' WHEN apart THEN 'no_observed_range_overlap' ELSE 'observed_ranges_overlap' END AS overlap, CASE WHEN n1 = 0 OR n2 = 0 THEN 'insufficient class data' WHEN z IS NULL THEN 'unavailable' ELSE 'available' END AS comparison, CASE WHEN n1 > 0 AND n2 > 0 THEN round_even(z, 8) END AS z FROM p LEFT JOIN w USING (column_name) LEFT JOIN z USING (column_name)""",
    "agg16_rank_test": f"""WITH {_F}, {_VL}, k AS (SELECT *, rank() OVER (PARTITION BY column_name ORDER BY value) + (count(*) OVER (PARTITION BY column_name, value) - 1) / 2 AS r FROM v WHERE value IS NOT NULL AND label IN ('real', 'ai_generated')),
t AS (SELECT column_name, sum(r) FILTER (label = 'real') AS r1, count(*) FILTER (label = 'real') AS n1, count(*) FILTER (label <> 'real') AS n2 FROM k GROUP BY 1)
SELECT column_name, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, round_even((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 8) AS z FROM t WHERE n1 >= 2 AND n2 >= 2""",
}
