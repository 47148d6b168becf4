"""Queries of report checks and observations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.operators import checks as ck
from reelgrain.operators import sequence as sq
from reelgrain.operators import timeline as tl
from reelgrain.plans import timelines
from reelgrain.plans.sequences import _S
from reelgrain.session import table


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Samples as frames: the value is brightness; dark, bright and sharp follow from it."""
    return sq.samples(table(s, d, "events"))


def _pairs(s: SparkSession, d: str, faults: bool) -> DataFrame:
    """Consecutive pairs; with faults every eleventh refers to no frame and every seventh has a wrong end."""
    p = sq.transitions(_frames(s, d)).select("entity", "from_index", "to_index", "start_seconds", "end_seconds", "difference", "distance", "before", "after")
    if not faults:
        return p
    return p.withColumns({"end_seconds": F.when(F.col("to_index") % 7 == 0, F.col("end_seconds") + 1).otherwise(F.col("end_seconds")), "to_index": F.when(F.col("to_index") % 11 == 0, F.col("to_index") + 100_000).otherwise(F.col("to_index"))})


def _observations(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    frames = _frames(s, d).withColumns({"dark_pixel_ratio": 1 - v / 100, "bright_pixel_ratio": v / 350, "laplacian_variance": v * 2, "n": F.col("sample_index"), "start_seconds": F.col("seconds"), "end_seconds": F.lit(None).cast("double")})
    pairs = _pairs(s, d, False).withColumns({"near_duplicate": (F.col("distance") <= 4) & (F.col("difference") <= 40), "large_change": (F.col("distance") >= 9) | (F.col("difference") >= 150), "brightness_jump": F.col("difference"), "n": F.col("to_index")})
    lost = _frames(s, d).filter("event_type = 'error'").select("entity", F.col("sample_index").alias("n"), F.col("seconds").alias("start_seconds"), F.lit(None).cast("double").alias("end_seconds"))
    return ck.observations([(frames, ck.frame_rules()), (pairs, ck.pair_rules()), (lost, {"frame_decoding_failed": F.lit(True)})])


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """Stated figures (every fifth entity's count and every seventh's mean are wrong) against the rows."""
    rows = _frames(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    stated = rows.withColumns({"n": F.when(F.col("entity") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")), "mean": F.when(F.col("entity") % 7 == 0, F.col("mean") + 0.01).otherwise(F.col("mean") + 0.0001)})
    return ck.summary_findings(stated, rows, ["entity"]).select("entity", "name")


def _intervals(s: SparkSession, d: str) -> DataFrame:
    rows = timelines.found(s, d).filter("role = 'anchor'").select("entity", "id", "start_seconds", "end_seconds")
    return ck.interval_findings(rows, 1200.0)


def _compact(s: SparkSession, d: str) -> DataFrame:
    rows, events, linked = timelines._parts(s, d)
    final = tl.compact_order(tl.finalised(rows, events, linked)).select("entity", "event", F.col("rank").alias("place"), F.concat_ws(" ", F.lit("event"), "class", "priority", "domains", "basis").alias("summary"), F.create_map(F.lit("groups"), "group_count", F.lit("members"), "primary_count").alias("metrics"))
    shown = tl.findings(rows, linked).groupBy("entity", "event").agg(F.array_sort(F.collect_list(F.struct("place", F.col("record_id").alias("record"), F.concat_ws(" ", F.lit("finding of"), "source_type", F.lit("in"), "domain").alias("summary")))).alias("findings"))
    paths = linked.select("entity", "event", F.concat(F.lit("frames/"), F.col("id").cast("string"), F.lit(".png")).alias("path")).groupBy("entity", "event").agg(F.array_sort(F.collect_set("path")).alias("artifacts"))
    return final.join(shown, ["entity", "event"]).join(paths, ["entity", "event"])


QUERIES = {
    "val01_text_rules": lambda s, d: ck.text_findings(ck.json_leaves(table(s, d, "report_raw").dropDuplicates(["report_id", "body"])), ("severity", "confidence", "verdict", "probability", "limitations")).groupBy("report_id", "rule").agg(F.count(F.lit(1)).alias("n")),
    "jsn03_leaves": lambda s, d: ck.json_leaves(table(s, d, "feature_export").select("record_id", "payload").distinct(), "record_id", "payload").filter("kind in ('integer', 'float')").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("high")),
    "jon04_pairs": lambda s, d: ck.pair_findings(_frames(s, d), _pairs(s, d, True)),
    "jon04_counts": lambda s, d: ck.pair_counts(_frames(s, d), _pairs(s, d, True).filter("from_index % 13 <> 0")),
    "sec33_summaries": _summaries,
    "val01_intervals": _intervals,
    "flt07_observations": _observations,
    "prj09_legacy": lambda s, d: ck.legacy_view({"frames": _observations(s, d), "findings": timelines.found(s, d).filter("role = 'anchor'").select("entity", F.col("candidate_id").alias("observation_id"), F.col("source_type").alias("type"))}).groupBy("category", "type", "severity").agg(F.count(F.lit(1)).alias("n")),
    "evd07_compact": lambda s, d: ck.compact_reports(_compact(s, d), 900, 1500).select("entity", "rung", "bytes", "fits"),
    "val09_compact_rules": lambda s, d: ck.compact_findings(ck.compact_reports(_compact(s, d), 900, 16000), 5, 800),
    "dat02_times": lambda s, d: ck.time_findings(table(s, d, "manifest").select("entry_id", "added_at", F.lit("2025-02-01T00:00:00+00:00").alias("closed_at")), "entry_id", "added_at", "closed_at").groupBy("rule").agg(F.count(F.lit(1)).alias("n")),
}

ORACLES = {
    "jsn03_leaves": "WITH r AS (SELECT DISTINCT record_id, payload FROM feature_export), p AS (SELECT TRY_CAST(payload AS JSON) AS j FROM r), k AS (SELECT j, UNNEST(json_keys(j)) AS name FROM p WHERE json_type(j) = 'OBJECT'), v AS (SELECT name, json_extract(j, '$.\"' || name || '\"') AS v FROM k) SELECT name, count(*) AS n, max(CAST(v AS DOUBLE)) AS high FROM v WHERE json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') GROUP BY 1",
    "jon04_pairs": f"""WITH {_S}, p AS (SELECT entity, from_index, CASE WHEN to_index % 11 = 0 THEN to_index + 100000 ELSE to_index END AS to_index, to_index AS own FROM t)
SELECT entity, from_index, to_index, 'unknown frame' AS rule FROM p WHERE own % 11 = 0 UNION ALL SELECT entity, from_index, to_index, 'end differs' FROM p WHERE own % 11 <> 0 AND own % 7 = 0""",
    "jon04_counts": f"WITH {_S}, f AS (SELECT entity, count(*) AS frames FROM s GROUP BY 1), p AS (SELECT entity, count(*) AS pairs FROM t WHERE from_index % 13 <> 0 GROUP BY 1) SELECT entity, frames, coalesce(pairs, 0) AS pairs FROM f LEFT JOIN p USING (entity) WHERE coalesce(pairs, 0) <> frames - 1",
    "sec33_summaries": "WITH e AS (SELECT DISTINCT user_id AS entity FROM events) SELECT entity, 'n' AS name FROM e WHERE entity % 5 = 0 UNION ALL SELECT entity, 'mean' FROM e WHERE entity % 7 = 0",
    "val01_intervals": f"""{timelines._TL}, b AS (SELECT entity, id, start_seconds, end_seconds, lag(end_seconds) OVER (PARTITION BY entity ORDER BY start_seconds, id) AS pe FROM c WHERE role = 'anchor')
SELECT entity, id, 'too short' AS rule FROM b WHERE end_seconds - start_seconds < 1200 UNION ALL SELECT entity, id, 'overlaps the one before' FROM b WHERE start_seconds < pe""",
    "flt07_observations": f"""WITH {_S}, x AS (
SELECT entity, 0 AS part, sample_index AS n, seconds AS a, NULL::DOUBLE AS b, 0 AS k, 'likely_near_black_sampled_frame' AS type FROM s WHERE 1 - value / 100 >= 0.98
UNION ALL SELECT entity, 0, sample_index, seconds, NULL, 1, 'likely_near_white_sampled_frame' FROM s WHERE value / 350 >= 0.98 UNION ALL SELECT entity, 0, sample_index, seconds, NULL, 2, 'low_sampled_frame_laplacian_variance' FROM s WHERE value * 2 < 50
UNION ALL SELECT entity, 1, to_index, start_seconds, end_seconds, 0, 'near_duplicate_sampled_frames' FROM t WHERE distance <= 4 AND difference <= 40 UNION ALL SELECT entity, 1, to_index, start_seconds, end_seconds, 1, 'large_sampled_frame_change' FROM t WHERE distance >= 9 OR difference >= 150
UNION ALL SELECT entity, 1, to_index, start_seconds, end_seconds, 2, 'significant_brightness_jump' FROM t WHERE difference >= 50 UNION ALL SELECT entity, 2, sample_index, seconds, NULL, 0, 'frame_decoding_failed' FROM s WHERE event_type = 'error')
SELECT entity, format('observation-{{:03d}}', row_number() OVER (PARTITION BY entity ORDER BY part, n, k)) AS observation_id, type, a AS start_seconds, b AS end_seconds FROM x""",
}
