"""Queries of the evidence timeline and of small utilities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.functions import scalars as sc
from reelgrain.operators import evidence as ev
from reelgrain.operators import sequence as sq
from reelgrain.operators import validation as va
from reelgrain.plans.sequences import _ANCHOR, _S, _SCENES, CUT, HOUR, _transitions
from reelgrain.session import table


def _intervals(s: SparkSession, d: str, kind: str) -> DataFrame:
    e = sq.samples(table(s, d, "events")).filter(F.col("event_type") == kind)
    return e.select("entity", F.col("tie").alias("id"), F.col("seconds").alias("start_seconds"), F.round(F.col("seconds") + 1800.0 + F.col("value") * 60, 6).alias("end_seconds"))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return ev.candidates({k: _intervals(s, d, k) for k in ("error", "purchase", "signup")}, {"error": "system", "purchase": "person", "signup": "person"}, ("error", "purchase"))


def _features(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "outcome_features").dropDuplicates(["record_id"])


def _rules(s: SparkSession, d: str) -> DataFrame:
    f = F.col
    return ev.rule_rows(_features(s, d), "run_id", "record_id", {"dark": f("frame_summary.dark_frame_ratio") >= 0.45, "white": f("frame_summary.white_frame_ratio") >= 0.45, "soft": f("frame_summary.mean_sharpness") < 50, "short": f("media.duration_seconds") < 1.0})


def _frame_summary(s: SparkSession, d: str) -> DataFrame:
    b = F.nanvl(F.col("frame_summary.mean_brightness"), F.lit(None).cast("double"))
    return _features(s, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), sc.half_even(F.avg(b), 8).alias("mean"), F.min(b).alias("low"), F.max(b).alias("high"), F.count_if(b < 80).alias("dim"))


def _first_fit(s: SparkSession, d: str) -> DataFrame:
    e = _intervals(s, d, "error").unionByName(_intervals(s, d, "purchase")).withColumn("end_seconds", F.col("start_seconds") + 8 * HOUR)
    return sq.first_fit(e.withColumns({"row": (F.col("id") % 4).cast("int"), "column": (F.floor(F.col("id") / 4) % 4).cast("int")}))


def _times(s: SparkSession, d: str) -> DataFrame:
    e = sq.samples(table(s, d, "events"))
    told = F.when(F.col("value") < 5, F.lit(None)).when(F.col("value") > 90, F.col("seconds") - 90000).otherwise(F.col("seconds")).cast("double")
    return sq.monotone_times(e.select("entity", "sample_index", told.alias("seconds")), 0.001)


def _ladder(s: SparkSession, d: str) -> DataFrame:
    c = lambda *names: F.concat_ws("|", *names)
    rungs = [("full", c("sample_id", "video_name", "video_sha256", "feature_file", "source", "notes")), ("without_notes", c("sample_id", "video_name", "video_sha256", "feature_file")), ("concise", c("sample_id"))]
    return sq.size_ladder(table(s, d, "manifest"), "entry_id", rungs, 180, 200)


def _strings(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest").groupBy("batch_no").agg(F.array_sort(F.collect_set("generator_or_camera")).alias("g"))
    return m.select("batch_no", F.size(ev.distinct_strings(F.col("g"))).alias("n"))


QUERIES = {
    "evd01_candidates": lambda s, d: _candidates(s, d).select("entity", "id", "domain", "role", "candidate_id"),
    "evd02_events": lambda s, d: ev.events(_candidates(s, d), 1800.0, 4 * HOUR),
    "flt07_rule_rows": _rules,
    "agg01_frame_summary": _frame_summary,
    "win12_first_fit": _first_fit,
    "scn09_times": _times,
    "win17_clip": lambda s, d: _features(s, d).select("record_id", sq.clip_start(F.col("media.duration_seconds")).alias("start")).filter("start is not null"),
    "srt08_scene_frames": lambda s, d: ev.scene_frames(sq.scenes(_transitions(s, d), F.col("difference") >= CUT), HOUR),
    "srt09_ladder": _ladder,
    "scn19_sidecar": lambda s, d: ev.latest_by_name(table(s, d, "manifest"), "video_name", "entry_id", ["entry_id", "expected_label"]).filter("name is not null"),
    "jon13_unique": lambda s, d: ev.unique_match(table(s, d, "outcome_features").dropDuplicates(["record_id"]).select("record_id", F.col("identity.video_name").alias("video_name")), table(s, d, "manifest").select("video_name", "sample_id"), "video_name", ["sample_id"]).select("record_id", "matched_sample_id"),
    "jon18_set_differences": lambda s, d: ev.set_differences(table(s, d, "outcome_features").select("sample_id").distinct(), table(s, d, "feature_export").select(F.get_json_object("payload", "$.sample_id").alias("sample_id")).distinct()).groupBy("side").agg(F.count(F.lit(1)).alias("n")),
    "set05_distinct_strings": _strings,
    "num04_frame_rates": lambda s, d: table(s, d, "part").select("p_partkey", F.round(sc.frame_rate(F.concat(F.col("p_size") * 1000, F.lit("/"), F.col("p_partkey") % 3)), 3).alias("rate")),
    "num06_rotation": lambda s, d: table(s, d, "customer").select("c_custkey", sc.rotation(F.col("c_custkey") * 90 - 5000).alias("rotation")),
    "str08_phrases": lambda s, d: table(s, d, "documents").filter(F.lower("text").rlike(r"not proof|no demuestra|keine bearbeitung")).select("doc_id"),
    "jsn01_fingerprints": lambda s, d: table(s, d, "manifest").select("entry_id", va.row_fingerprint(["sample_id", "video_name", "feature_file", "source", "notes", "batch_no"]).alias("fingerprint")),
    "map02_encoding": lambda s, d: _features(s, d).select("run_id", F.try_element_at(F.create_map(F.lit("real"), F.lit(0), F.lit("ai_generated"), F.lit(1)), F.col("identity.expected_label")).alias("code")).groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n")),
    "arr01_slices": lambda s, d: table(s, d, "embeddings").select("vec_id", F.size(F.filter(F.slice("embedding", 1, 8), lambda x: x > 0)).alias("positive")),
}

_FD = "f AS (SELECT * FROM outcome_features QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_C = "c AS (SELECT entity, tie AS id, event_type AS domain, CASE WHEN event_type = 'signup' THEN 'supporting' ELSE 'anchor' END AS role, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS o, seconds FROM s WHERE event_type IN ('error', 'purchase', 'signup'))"
# half-even to milliseconds, counted in tenths of microseconds
_even = lambda x: f"(CAST(round(({x}) * 1e7) AS BIGINT) // 10000 + CASE WHEN CAST(round(({x}) * 1e7) AS BIGINT) % 10000 > 5000 OR (CAST(round(({x}) * 1e7) AS BIGINT) % 10000 = 5000 AND CAST(round(({x}) * 1e7) AS BIGINT) // 10000 % 2 = 1) THEN 1 ELSE 0 END) / 1000"
_len = lambda *c: "strlen(concat_ws('|', " + ", ".join(c) + "))"

ORACLES = {
    "evd01_candidates": f"WITH {_S}, {_C} SELECT entity, id, domain, role, format('cand-{{:05d}}', row_number() OVER (PARTITION BY entity ORDER BY o, seconds, id)) AS candidate_id FROM c",
    "evd02_events": f"""WITH RECURSIVE {_S}, {_ANCHOR}, o AS (SELECT a.*, s.event_type, row_number() OVER (PARTITION BY a.entity ORDER BY start_seconds, end_seconds, id) AS k FROM a JOIN s ON s.tie = a.id),
m AS (SELECT entity, k, id, 1 AS event, start_seconds AS gs, end_seconds AS ge FROM o WHERE k = 1
UNION ALL SELECT o.entity, o.k, o.id, CASE WHEN j THEN event ELSE event + 1 END, CASE WHEN j THEN gs ELSE o.start_seconds END, CASE WHEN j THEN greatest(ge, o.end_seconds) ELSE o.end_seconds END
FROM (SELECT m.*, o2.id AS oid, greatest(0, o2.start_seconds - m.ge) <= 1800 + 1e-9 AND greatest(m.ge, o2.end_seconds) - m.gs <= 14400 + 1e-9 AS j FROM m JOIN o o2 ON o2.entity = m.entity AND o2.k = m.k + 1) m JOIN o ON o.id = m.oid),
g AS (SELECT m.entity, m.event, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, count(*) AS candidates, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS domains, count(DISTINCT event_type) AS groups FROM m JOIN o ON o.id = m.id GROUP BY 1, 2)
SELECT *, CASE WHEN groups > 1 THEN 'several_groups' WHEN candidates > 1 THEN 'one_group' ELSE 'single' END AS agreement FROM g""",
    "flt07_rule_rows": f"""WITH {_FD}, r AS (SELECT run_id, record_id, 0 AS k, 'dark' AS rule FROM f WHERE frame_summary.dark_frame_ratio >= 0.45 UNION ALL SELECT run_id, record_id, 1, 'white' FROM f WHERE frame_summary.white_frame_ratio >= 0.45
UNION ALL SELECT run_id, record_id, 2, 'soft' FROM f WHERE frame_summary.mean_sharpness < 50 UNION ALL SELECT run_id, record_id, 3, 'short' FROM f WHERE media.duration_seconds < 1)
SELECT run_id, record_id, rule, format('obs-{{:05d}}', row_number() OVER (PARTITION BY run_id ORDER BY record_id, k)) AS observation_id FROM r""",
    "agg01_frame_summary": f"WITH {_FD}, b AS (SELECT run_id, CASE WHEN NOT isnan(frame_summary.mean_brightness) THEN frame_summary.mean_brightness END AS b FROM f) SELECT run_id, count(*) AS n, round_even(avg(b), 8) AS mean, min(b) AS low, max(b) AS high, count(*) FILTER (b < 80) AS dim FROM b GROUP BY 1",
    "win17_clip": f"WITH {_FD} SELECT record_id, CASE WHEN d <= 3 THEN 0.0 ELSE floor((d - 3) * 0.6394267984578837) END AS start FROM (SELECT record_id, media.duration_seconds AS d FROM f) WHERE d IS NOT NULL",
    "srt08_scene_frames": f"""WITH {_S}, {_SCENES}, x AS (SELECT entity, scene_index, start_seconds AS a, end_seconds AS b FROM sc)
SELECT DISTINCT entity, scene_index, UNNEST(CASE WHEN b - a < 3600 THEN [{_even('(a + b) / 2')}] ELSE [{_even('a')}, {_even('(a + b) / 2')}, {_even('b')}] END) AS seconds FROM x""",
    "srt09_ladder": f"""WITH b AS (SELECT entry_id, {_len('sample_id', 'video_name', 'video_sha256', 'feature_file', 'source', 'notes')} AS a, {_len('sample_id', 'video_name', 'video_sha256', 'feature_file')} AS b, {_len('sample_id')} AS c FROM manifest)
SELECT entry_id, CASE WHEN a <= 180 THEN 'full' WHEN b <= 180 THEN 'without_notes' ELSE 'concise' END AS name, CASE WHEN a <= 180 THEN a WHEN b <= 180 THEN b ELSE c END AS bytes, CASE WHEN a <= 180 THEN a WHEN b <= 180 THEN b ELSE c END <= 200 AS fits FROM b""",
    "scn19_sidecar": "SELECT lower(video_name) AS name, max(entry_id) AS entry_id, arg_max_null(expected_label, entry_id) AS expected_label FROM manifest WHERE video_name IS NOT NULL GROUP BY 1",
    "jon13_unique": f"WITH {_FD}, u AS (SELECT lower(video_name) AS n, any_value(sample_id) AS s, count(*) AS k FROM manifest GROUP BY 1 HAVING count(*) = 1) SELECT record_id, u.s AS matched_sample_id FROM f JOIN u ON u.n = lower(identity.video_name)",
    "jon18_set_differences": "WITH l AS (SELECT DISTINCT sample_id FROM outcome_features), r AS (SELECT DISTINCT json_extract_string(payload, '$.sample_id') AS sample_id FROM feature_export) SELECT 'left' AS side, count(*) AS n FROM (FROM l EXCEPT ALL FROM r) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (FROM r EXCEPT ALL FROM l) HAVING count(*) > 0",
    "set05_distinct_strings": "SELECT batch_no, count(DISTINCT lower(trim(generator_or_camera))) AS n FROM manifest GROUP BY 1",
    "num04_frame_rates": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_size > 0 THEN round(p_size * 1000 / (p_partkey % 3), 3) END AS rate FROM part",
    "num06_rotation": "SELECT c_custkey, ((c_custkey * 90 - 5000) % 360 + 360) % 360 AS rotation FROM customer",
    "str08_phrases": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'not proof|no demuestra|keine bearbeitung')",
    "jsn01_fingerprints": "SELECT entry_id, sha256(CAST(to_json({'batch_no': batch_no, 'feature_file': feature_file, 'notes': notes, 'sample_id': sample_id, 'source': source, 'video_name': video_name}) AS VARCHAR)) AS fingerprint FROM manifest",
    "map02_encoding": f"WITH {_FD} SELECT run_id, CASE identity.expected_label WHEN 'real' THEN 0 WHEN 'ai_generated' THEN 1 END AS code, count(*) AS n FROM f GROUP BY 1, 2",
    "arr01_slices": "SELECT vec_id, len(list_filter(embedding[1:8], lambda x: x > 0)) AS positive FROM embeddings",
}
