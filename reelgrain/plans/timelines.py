"""Queries of the evidence timeline over the events table (an entity is a user), with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.operators import sequence as sq
from reelgrain.operators import timeline as tl
from reelgrain.plans.sequences import _S
from reelgrain.session import table, written

GAP, SPAN, CELL = 1800.0, 14400.0, 21600.0
#: event_type -> source type, domain, length in seconds.
SOURCES = {
    "view": ("ranked_review_transition", "visual_temporal", 900), "error": ("ranked_audio_energy_transition", "audio_signal", 1800), "purchase": ("sampled_frame_comparison", "frame_sampling", 600),
    "click": ("silence_like_audio_interval", "audio_signal", 9000), "signup": ("sustained_near_static_interval", "visual_temporal", 7200),
}


def _pick(i: int) -> Column:
    return reduce(lambda c, x: c.when(F.col("event_type") == x[0], x[1][i]), SOURCES.items(), F.when(F.lit(False), SOURCES["view"][i]))


def found(s: SparkSession, d: str) -> DataFrame:
    e = sq.samples(table(s, d, "events"))
    rows = e.select(
        "entity", F.col("tie").alias("id"), _pick(0).alias("source_type"), _pick(1).alias("domain"), F.col("tie").cast("string").alias("record_id"), F.col("seconds").alias("start_seconds"), F.round(F.col("seconds") + _pick(2) + F.col("value") * 60, 6).alias("end_seconds"),
        F.col("value").alias("percentile"), F.when(F.col("tie") % 3 == 0, F.array(F.concat(F.lit("a"), F.col("tie") % 5))).alias("artifacts"),
    )
    return tl.with_roles(rows, SPAN)


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, events and members, each written once, as all that follows reads them several times."""
    rows = written(found(s, d), "candidates")
    return (rows, *(written(part, "timeline") for part in tl.members(rows, GAP, SPAN, CELL)))


def _final(s: SparkSession, d: str) -> DataFrame:
    return tl.finalised(*_parts(s, d))


def _findings(s: SparkSession, d: str) -> DataFrame:
    rows, _, linked = _parts(s, d)
    return tl.findings(rows, linked).select("entity", "event", "id", "place", "available")


def _distinct_findings(s: SparkSession, d: str) -> DataFrame:
    rows, _, linked = _parts(s, d)
    both = linked.join(rows, ["entity", "id"]).withColumns({"record_id": F.col("percentile").cast("int").cast("string"), "summary": F.col("source_type"), "metrics": F.create_map(F.when(F.col("id") % 2 == 0, "x").otherwise("y"), F.col("percentile"))})
    return tl.distinct_findings(both).select("entity", "event", "id")


def _artifacts(s: SparkSession, d: str) -> DataFrame:
    rows, _, linked = _parts(s, d)
    labels = F.array(*map(F.lit, (*tl.ARTIFACT_LABELS, "other")))
    each = linked.join(rows, ["entity", "id"]).select("entity", "event", F.element_at(labels, (F.col("id") % 7 + 1).cast("int")).alias("label"), F.concat(F.lit("p"), F.col("id") % 11).alias("path"))
    return tl.ordered_artifacts(each)


QUERIES = {
    "evd01_roles": lambda s, d: found(s, d).select("entity", "id", "source_type", "role", "candidate_id"),
    "evd02_members": lambda s, d: _parts(s, d)[2],
    "evd02_timeline": _final,
    "win13_review": lambda s, d: tl.highlights(_final(s, d)).select("entity", "event", "rank"),
    "srt06_compact_order": lambda s, d: tl.compact_order(_final(s, d)).select("entity", "event", "rank"),
    "win14_findings": _findings,
    "set06_findings": _distinct_findings,
    "srt07_artifacts": _artifacts,
    "jon17_review_events": lambda s, d: (lambda f: tl.highlights(f).select("entity", "event", "rank").join(f.select("entity", "event", "start_seconds", "class", "priority"), ["entity", "event"]))(_final(s, d)),
    "val08_timeline_rules": lambda s, d: tl.violations(*_parts(s, d), SPAN),
    "val08_broken_rules": lambda s, d: (lambda r, e, m: tl.violations(r.withColumn("domain", F.when(F.col("id") % 50 == 0, "unknown").otherwise(F.col("domain"))), e, m.filter("id % 40 <> 0"), SPAN))(*_parts(s, d)),
}

_case = lambda i: "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[i]!r}" for k, v in SOURCES.items()) + " END"
_near = lambda a, b: f"least({a}.end_seconds, {b}.end_seconds) - greatest({a}.start_seconds, {b}.start_seconds)"
_TL = f"""WITH RECURSIVE {_S},
c0 AS (SELECT entity, tie AS id, {_case(0)} AS source_type, {_case(1)} AS domain, CAST(tie AS VARCHAR) AS record_id, seconds AS start_seconds, round(seconds + {_case(2)} + value * 60, 6) AS end_seconds, value AS percentile, CASE WHEN tie % 3 = 0 THEN 'a' || (tie % 5) END AS artifact FROM s),
c AS (SELECT *, CASE WHEN source_type IN ('ranked_review_transition', 'ranked_audio_energy_transition', 'sampled_frame_comparison') THEN 'anchor' WHEN source_type = 'sustained_near_static_interval' OR end_seconds - start_seconds > {SPAN} THEN 'contextual' ELSE 'supporting' END AS role,
 format('evidence-candidate-{{:05d}}', row_number() OVER (PARTITION BY entity ORDER BY id)) AS candidate_id FROM c0),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start_seconds, end_seconds, id) AS k FROM c WHERE role = 'anchor'),
m AS (SELECT entity, k, id, 1 AS grp, start_seconds AS gs, end_seconds AS ge FROM o WHERE k = 1
UNION ALL SELECT o.entity, o.k, o.id, CASE WHEN j THEN grp ELSE grp + 1 END, CASE WHEN j THEN gs ELSE o.start_seconds END, CASE WHEN j THEN greatest(ge, o.end_seconds) ELSE o.end_seconds END
FROM (SELECT m.*, o2.id AS oid, greatest(0, o2.start_seconds - m.ge) <= {GAP} + 1e-9 AND greatest(m.ge, o2.end_seconds) - m.gs <= {SPAN} + 1e-9 AS j FROM m JOIN o o2 ON o2.entity = m.entity AND o2.k = m.k + 1) m JOIN o ON o.id = m.oid),
g AS (SELECT m.entity, grp AS gid, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds FROM m JOIN o ON o.id = m.id GROUP BY 1, 2),
u AS (SELECT * FROM c WHERE role = 'supporting'), x AS (SELECT * FROM c WHERE role = 'contextual'),
p AS (SELECT u.entity, u.id, g.gid, g.start_seconds AS rs, round(greatest(0, {_near('u', 'g')}), 6) AS ov, greatest(least(u.end_seconds - u.start_seconds, g.end_seconds - g.start_seconds), 1e-9) AS shorter, round(abs((u.start_seconds + u.end_seconds - g.start_seconds - g.end_seconds) / 2), 6) AS mid FROM u JOIN g ON u.entity = g.entity AND {_near('u', 'g')} >= -{GAP}),
best AS (SELECT entity, id, gid FROM p QUALIFY row_number() OVER (PARTITION BY entity, id ORDER BY ov DESC, round(ov / shorter, 6) DESC, mid, rs, gid) = 1),
e0 AS (SELECT entity, gid, start_seconds, end_seconds, false AS standalone FROM g UNION ALL SELECT entity, -id - 1, start_seconds, end_seconds, true FROM u WHERE id NOT IN (SELECT id FROM best)),
e AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start_seconds, end_seconds, CASE WHEN standalone THEN 0 ELSE 1 END, CASE WHEN standalone THEN -gid ELSE gid END) AS event FROM e0),
l0 AS (SELECT entity, id, grp AS gid, 'anchor' AS relation FROM m UNION ALL SELECT *, 'primary' FROM best UNION ALL SELECT entity, id, -id - 1, 'primary' FROM u WHERE id NOT IN (SELECT id FROM best)
 UNION ALL SELECT entity, id, gid, 'context' FROM p WHERE (id, gid) NOT IN (SELECT (id, gid) FROM best) UNION ALL SELECT x.entity, x.id, e.gid, 'context' FROM x JOIN e ON e.entity = x.entity AND {_near('x', 'e')} >= -{GAP}),
l AS (SELECT l0.entity, e.event, id, relation FROM l0 JOIN e ON e.entity = l0.entity AND e.gid = l0.gid),
r AS (SELECT l.*, c.* EXCLUDE (entity, id), CASE domain WHEN 'audio_signal' THEN 'audio' ELSE 'visual' END AS dg FROM l JOIN c ON c.id = l.id),
q0 AS (SELECT entity, event, array_to_string(list_sort(list(DISTINCT domain) FILTER (relation <> 'context')), ',') AS domains, array_to_string(list_sort(list(DISTINCT dg)), ',') AS groups, count(DISTINCT dg) AS group_count, count(DISTINCT domain) FILTER (domain <> 'audio_signal') AS visual_methods, bool_or(domain = 'audio_signal') AS audio,
 bool_or(source_type = 'sustained_near_static_interval') AS near_static, bool_or(source_type = 'ranked_audio_energy_transition') AS audio_transition, bool_or(relation <> 'context' AND source_type LIKE '%ranked%') AS ranked, count(*) FILTER (relation = 'context') AS context_count, count(*) FILTER (relation <> 'context') AS primary_count, max(percentile) AS percentile, CAST(count(DISTINCT artifact) AS INT) AS artifacts FROM r GROUP BY 1, 2),
q AS (SELECT e.* EXCLUDE (gid), q0.* EXCLUDE (entity, event), CASE WHEN visual_methods > 0 AND audio THEN 'visual_and_audio_aligned' WHEN near_static AND audio THEN 'near_static_with_audio_activity' WHEN visual_methods >= 2 THEN 'multiple_visual_methods' WHEN visual_methods > 0 THEN 'visual_only' WHEN audio THEN 'audio_only' ELSE 'other' END AS class,
 list_filter([CASE WHEN group_count >= 2 THEN 'multiple_independent_evidence_groups' END, CASE WHEN visual_methods >= 2 THEN 'multiple_visual_methods' END, CASE WHEN visual_methods > 0 AND audio THEN 'audio_visual_temporal_overlap' END, CASE WHEN ranked THEN 'ranked_source_findings' END, CASE WHEN artifacts > 0 THEN 'review_artifacts_available' END, CASE WHEN context_count > 0 THEN 'contextual_interval_available' END], lambda b: b IS NOT NULL) AS bl FROM e JOIN q0 ON q0.entity = e.entity AND q0.event = e.event),
f AS (SELECT * EXCLUDE (bl), array_to_string(bl, '|') AS basis, CASE WHEN group_count >= 2 AND (visual_methods > 0 AND audio OR visual_methods >= 2) THEN 'high' WHEN len(bl) >= 2 OR ranked THEN 'moderate' ELSE 'low' END AS priority FROM q)"""
_LV = "CASE priority WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END"
_HL = f"h AS (SELECT entity, event, row_number() OVER (PARTITION BY entity ORDER BY {_LV}, group_count DESC, percentile DESC, artifacts DESC, start_seconds, event) AS rank FROM f QUALIFY rank <= 10)"
_RO = "CASE role WHEN 'anchor' THEN 1 WHEN 'supporting' THEN 2 ELSE 3 END, CASE WHEN source_type LIKE '%ranked%' THEN 0 ELSE 1 END, domain, record_id, id"
_CAP = "CASE domain WHEN 'visual_temporal' THEN 3 WHEN 'audio_signal' THEN 2 WHEN 'frame_sampling' THEN 1 END"

ORACLES = {
    "evd01_roles": f"{_TL} SELECT entity, id, source_type, role, candidate_id FROM c",
    "evd02_members": f"{_TL} FROM l",
    "evd02_timeline": f"{_TL} FROM f",
    "win13_review": f"{_TL}, {_HL} FROM h",
    "srt06_compact_order": f"""{_TL} SELECT entity, event, row_number() OVER (PARTITION BY entity ORDER BY {_LV}, group_count DESC, CASE WHEN contains(basis, 'audio_visual_temporal_overlap') OR class = 'visual_and_audio_aligned' THEN 0 ELSE 1 END, CASE WHEN contains(basis, 'multiple_visual_methods') OR class = 'multiple_visual_methods' THEN 0 ELSE 1 END,
CASE WHEN contains(basis, 'ranked_source_findings') THEN 0 ELSE 1 END, percentile DESC, start_seconds, event) AS rank FROM f QUALIFY rank <= 5""",
    "win14_findings": f"""{_TL}, w AS (SELECT *, count(*) OVER (PARTITION BY entity, event) AS n, count(*) OVER (PARTITION BY entity, event, domain) AS own, row_number() OVER (PARTITION BY entity, event, domain ORDER BY {_RO}) AS dr, {_CAP} AS cap FROM r),
w2 AS (SELECT *, min(domain) OVER v = max(domain) OVER v AS one, bool_or(own > cap) OVER v AS ovr FROM w WINDOW v AS (PARTITION BY entity, event)), w3 AS (SELECT *, n <= 8 AND (one OR NOT ovr) AS pass FROM w2)
SELECT entity, event, id, row_number() OVER (PARTITION BY entity, event ORDER BY CASE WHEN pass OR dr = 1 THEN 0 ELSE 1 END, CASE WHEN NOT pass AND dr = 1 THEN domain END NULLS FIRST, {_RO}) AS place, n AS available FROM w3 WHERE pass OR one OR dr <= cap QUALIFY pass OR place <= 8""",
    "set06_findings": f"{_TL} SELECT entity, event, min(id) AS id FROM r GROUP BY entity, event, CAST(trunc(percentile) AS INT), domain, source_type, id % 2",
    "srt07_artifacts": f"""{_TL}, y AS (SELECT entity, event, ['before_frame', 'after_frame', 'absolute_difference', 'flow_warp_residual', 'combined_heatmap', 'detail_residual_heatmap', 'other'][id % 7 + 1] AS label, id % 7 AS k, 'p' || (id % 11) AS path FROM r),
z AS (SELECT entity, event, path, min(k) AS k, arg_min(label, k) AS label FROM y GROUP BY 1, 2, 3) SELECT entity, event, path, label, row_number() OVER (PARTITION BY entity, event ORDER BY k, label, path) AS place FROM z QUALIFY place <= 4""",
    "jon17_review_events": f"{_TL}, {_HL} SELECT h.*, f.start_seconds, f.class, f.priority FROM h JOIN f ON f.entity = h.entity AND f.event = h.event",
    "val08_timeline_rules": f"{_TL} SELECT entity, CAST(id AS BIGINT) AS subject, 'candidate lost' AS rule FROM c WHERE role <> 'contextual' AND id NOT IN (SELECT id FROM l WHERE relation <> 'context') UNION ALL SELECT entity, event, 'event too long' FROM f WHERE NOT standalone AND round(end_seconds - start_seconds, 6) > {SPAN}",
    "val08_broken_rules": f"""{_TL}, lk AS (SELECT * FROM l WHERE id % 40 <> 0), ext AS (SELECT lk.entity, event, min(start_seconds) AS a, max(end_seconds) AS b FROM lk JOIN c ON c.id = lk.id WHERE relation = 'anchor' GROUP BY 1, 2)
SELECT entity, CAST(id AS BIGINT) AS subject, 'domain unknown' AS rule FROM c WHERE id % 50 = 0 UNION ALL SELECT entity, id, 'candidate lost' FROM c WHERE role <> 'contextual' AND id NOT IN (SELECT id FROM lk WHERE relation <> 'context') UNION ALL SELECT entity, id, 'anchor not in one event' FROM c WHERE role = 'anchor' AND id NOT IN (SELECT id FROM lk WHERE relation <> 'context')
UNION ALL SELECT e.entity, e.event, 'event without anchor' FROM e LEFT JOIN ext ON ext.entity = e.entity AND ext.event = e.event WHERE a IS NULL AND NOT standalone UNION ALL SELECT e.entity, e.event, 'extent is not the anchors''' FROM e JOIN ext ON ext.entity = e.entity AND ext.event = e.event WHERE a <> start_seconds OR b <> end_seconds
UNION ALL SELECT e.entity, e.event, 'event too long' FROM e JOIN ext ON ext.entity = e.entity AND ext.event = e.event WHERE round(end_seconds - start_seconds, 6) > {SPAN}""",
}
