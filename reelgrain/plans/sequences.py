"""Queries of the sequence and interval operators over the events table (an entity is a user), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.functions import scalars as sc
from reelgrain.operators import intervals as iv
from reelgrain.operators import sequence as sq
from reelgrain.session import table


def _samples(s: SparkSession, d: str) -> DataFrame:
    return sq.samples(table(s, d, "events"))


def _transitions(s: SparkSession, d: str) -> DataFrame:
    return sq.transitions(_samples(s, d))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _r8(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: sc.half_even(F.col(c), 8) for c in columns})


CUT, STILL, HOUR = 150.0, 40.0, 3600.0


def _classified(s: SparkSession, d: str) -> DataFrame:
    scene, still = (F.col("difference") >= CUT) | (F.col("distance") >= 9), (F.col("difference") <= STILL) & (F.col("distance") <= 4)
    rules = {"large_difference": ("scene", F.col("difference") >= CUT), "large_distance": ("scene", F.col("distance") >= 9), "small_difference": ("still", F.col("difference") <= STILL), "small_distance": ("still", F.col("distance") <= 4)}
    return sq.classify(_transitions(s, d), rules, {"scene": scene, "still": still})


def _motion_class(s: SparkSession, d: str) -> DataFrame:
    x = F.col("difference")
    return _transitions(s, d).select("entity", "to_index", F.when(x >= CUT, "high").when(F.col("distance") <= 3, "mostly_stationary").otherwise("moderate").alias("motion"))


def _scene_lookup(s: SparkSession, d: str) -> DataFrame:
    t = _transitions(s, d)
    return sq.scene_of(t, sq.scenes(t, F.col("difference") >= CUT))


def _regional(s: SparkSession, d: str) -> DataFrame:
    t = _transitions(s, d)
    return sq.islands(t, F.col("difference") <= 2 * STILL, HOUR, key=("entity", "event_type"), adjacent=True, least_count=2)


def _silence(s: SparkSession, d: str) -> DataFrame:
    w = sq.sliding(_samples(s, d), 8, 4)
    rows = w.select("entity", F.col("window_index").alias("from_index"), "start_seconds", "end_seconds", F.col("rms").alias("difference"))
    return _r(sq.islands(rows, F.col("difference") <= 60, HOUR), "max_difference", "mean_difference")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return _transitions(s, d).withColumns({"distance": F.col("distance").cast("double"), "elapsed": F.round(F.col("end_seconds") - F.col("start_seconds"), 6)})


def _anchors(s: SparkSession, d: str, kinds: tuple[str, ...] = ("error", "purchase"), length: float = 1800.0) -> DataFrame:
    e = _samples(s, d).filter(F.col("event_type").isin(*kinds))
    return e.select("entity", F.col("tie").alias("id"), "event_type", F.col("seconds").alias("start_seconds"), F.round(F.col("seconds") + length + F.col("value") * 60, 6).alias("end_seconds"))


def _supports(s: SparkSession, d: str) -> DataFrame:
    return _anchors(s, d, ("signup",), 7200.0)


def _findings(s: SparkSession, d: str) -> DataFrame:
    return sq.balanced_top(_samples(s, d).filter("event_type <> 'view'"), "entity", "event_type", [F.desc("value"), F.asc("tie")], {"signup": 3, "error": 3, "click": 2, "purchase": 1}, 8).select("entity", "tie", "rank")


QUERIES = {
    "jon01_pairs": lambda s, d: _r(_transitions(s, d).drop("event_type"), "difference"),
    "flt02_classified": lambda s, d: _classified(s, d).select("entity", "to_index", "scene", "still", F.array_join("triggered_rules", ",").alias("rules")),
    "flt05_motion_class": _motion_class,
    "win01_scenes": lambda s, d: _r8(sq.scenes(_transitions(s, d), F.col("difference") >= CUT), "mean_difference", "median_difference"),
    "win02_still_runs": lambda s, d: _r(sq.islands(_transitions(s, d), F.col("difference") <= STILL, HOUR), "max_difference", "mean_difference"),
    "win03_quiet_runs": _silence,
    "win04_regional_runs": lambda s, d: _r(_regional(s, d), "max_difference", "mean_difference"),
    "win05_windows": lambda s, d: _r(sq.sliding(_samples(s, d), 8, 4), "rms", "peak", "mean"),
    "win06_thinned": lambda s, d: sq.thin(_samples(s, d), 1 / 86400.0, 20),
    "win07_plan": lambda s, d: sq.timestamp_plan(table(s, d, "outcome_features").select("record_id", F.col("media.duration_seconds").alias("duration")).filter("not isnan(duration)").dropDuplicates(["record_id"]), "duration").select("record_id", F.size("times").alias("n"), F.element_at("times", -1).alias("last_time"), F.round(F.aggregate("times", F.lit(0.0), lambda a, x: a + x), 2).alias("total")),
    "win08_ranked": lambda s, d: sq.rank_by_metrics(_metrics(s, d), ["difference", "distance", "elapsed", "after"]).select("entity", "from_index", "combined", F.array_join("reasons", ",").alias("reasons"), "rank"),
    "win09_ranked_fixed": lambda s, d: sq.rank_by_metrics(_metrics(s, d).withColumn("after", F.when(F.col("distance") > 3, F.col("after"))), ["difference", "distance", "after"], available_only=False).select("entity", "from_index", "combined", "rank"),
    "win10_jumps": lambda s, d: sq.rank_ratio_jumps(sq.sliding(_samples(s, d), 8, 4)).select("entity", "window_index", "ratio"),
    "win11_events": lambda s, d: sq.merge_anchors(_anchors(s, d), 1800.0, 4 * HOUR),
    "win13_highlights": lambda s, d: sq.best_per_group(_samples(s, d), ["entity"], [F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2), F.desc("value"), F.asc("seconds"), F.asc("tie")], 10).select("entity", "tie", "rank"),
    "win14_balanced": _findings,
    "win15_crossings": lambda s, d: _r(sq.zero_crossings(_samples(s, d), 50.0), "crossing_rate"),
    "win16_vector_differences": lambda s, d: sq.vector_differences(table(s, d, "embeddings")).select("label", "vec_id", F.round("first_difference", 4).alias("first_difference"), F.round("cosine", 4).alias("cosine")),
    "agg25_second_order": lambda s, d: sq.second_order_summary(sq.vector_differences(table(s, d, "embeddings"))).select("label", "n", F.round("mean", 3).alias("mean"), F.round("deviation", 3).alias("deviation")),
    "win18_ids": lambda s, d: _anchors(s, d).select("id", F.format_string("cand-%05d", F.row_number().over(sq.Window.partitionBy("entity").orderBy("start_seconds", "id"))).alias("candidate_id")),
    "win19_order_violations": lambda s, d: sq.order_violations(table(s, d, "events"), ["user_id"], "event_id", "value").select("event_id", "value", "before_value"),
    "jon08_band": lambda s, d: iv.band_equal(_anchors(s, d), _supports(s, d), 900.0),
    "jon09_best_event": lambda s, d: iv.best_match(_supports(s, d), _anchors(s, d), 900.0, 6 * HOUR).select("entity", "l_id", "r_id"),
    "jon10_context": lambda s, d: iv.near_pairs(_supports(s, d), _anchors(s, d), 900.0, 6 * HOUR).select("entity", "l_id", "r_id", F.round("overlap", 3).alias("overlap"), F.round("gap", 3).alias("gap")),
    "evd03_unmatched": lambda s, d: iv.unmatched(_supports(s, d), _anchors(s, d), 900.0, 6 * HOUR).select("entity", "id"),
    "jon07_scene_of": _scene_lookup,
    "agg03_coverage": lambda s, d: _samples(s, d).groupBy("entity").agg(F.min("seconds").alias("first"), F.max("seconds").alias("last"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.max("seconds") - F.min("seconds")) / (30 * 86400))), 6).alias("coverage")),
    "agg02_summary": lambda s, d: _classified(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("scene").alias("scenes"), F.count_if("still").alias("stills"), F.round(F.avg("difference"), 6).alias("mean"), F.max("difference").alias("high")),
    "agg28_repeated": lambda s, d: table(s, d, "events").groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
}

_S = """
s AS (SELECT user_id AS entity, row_number() OVER w - 1 AS sample_index, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS seconds, value, event_id AS tie, event_type
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT entity, lag(sample_index) OVER w AS from_index, sample_index AS to_index, lag(seconds) OVER w AS start_seconds, seconds AS end_seconds, abs(value - lag(value) OVER w) AS difference,
 bit_count(xor(tie, lag(tie) OVER w)) AS distance, value AS after, lag(value) OVER w AS before, event_type FROM s WINDOW w AS (PARTITION BY entity ORDER BY sample_index) QUALIFY from_index IS NOT NULL)"""
_W = """
n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM s),
wi AS (SELECT n.*, k AS window_index FROM n, LATERAL (SELECT UNNEST(range(0, CAST(ceil(greatest(0, n.n - 8) / 4.0) AS BIGINT) + 1)) AS k) WHERE sample_index >= k * 4 AND sample_index < k * 4 + 8),
w AS (SELECT entity, window_index, min(sample_index) AS first_sample, count(*) AS sample_count, min(seconds) AS start_seconds, max(seconds) AS end_seconds, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, avg(value) AS mean FROM wi GROUP BY 1, 2)"""
_ANCHOR = """
a AS (SELECT entity, tie AS id, seconds AS start_seconds, round(seconds + 1800.0 + value * 60, 6) AS end_seconds FROM s WHERE event_type IN ('error', 'purchase')),
u AS (SELECT entity, tie AS id, seconds AS start_seconds, round(seconds + 7200.0 + value * 60, 6) AS end_seconds FROM s WHERE event_type = 'signup'),
p AS (SELECT u.entity, u.id AS l_id, a.id AS r_id, a.start_seconds AS rs, least(u.end_seconds, a.end_seconds) - greatest(u.start_seconds, a.start_seconds) AS o,
 greatest(least(u.end_seconds - u.start_seconds, a.end_seconds - a.start_seconds), 1e-9) AS shorter, abs((u.start_seconds + u.end_seconds - a.start_seconds - a.end_seconds) / 2) AS mid
 FROM u JOIN a ON u.entity = a.entity AND u.start_seconds <= a.end_seconds + 900 AND a.start_seconds <= u.end_seconds + 900)"""


def _islands(source: str, flag: str, key: str, extra: str = "", least_count: int = 1) -> str:
    return f"""
f AS (SELECT *, ({flag}) AS flag FROM {source}),
st AS (SELECT *, (flag AND NOT coalesce(lag(flag) OVER w, false)) {extra} AS start FROM f WINDOW w AS (PARTITION BY {key} ORDER BY from_index)),
r AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY {key} ORDER BY from_index) AS run FROM st),
i AS (SELECT {key}, run, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, count(*) AS transition_count, round(max(difference), 6) AS max_difference, round(avg(difference), 6) AS mean_difference FROM r WHERE flag GROUP BY {key}, run)
SELECT {key}, start_seconds, end_seconds, transition_count, max_difference, mean_difference, round(end_seconds - start_seconds, 6) AS duration, row_number() OVER (PARTITION BY {key} ORDER BY start_seconds, run) AS interval_index FROM i WHERE round(end_seconds - start_seconds, 6) >= 3600 AND transition_count >= {least_count}"""


def _ranked(metrics: dict[str, str], total: str) -> str:
    long = " UNION ALL ".join(f"SELECT entity, from_index, '{m}' AS metric, CAST({x} AS DOUBLE) AS x FROM t" for m, x in metrics.items())
    return f"""WITH {_S}, l AS ({long}), k AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY x DESC, from_index) AS rank, count(*) OVER (PARTITION BY entity, metric) AS n FROM l WHERE x IS NOT NULL),
g AS (SELECT entity, from_index, round(sum(CASE WHEN n > 1 THEN round(1 - (rank - 1) / (n - 1), 6) ELSE 1.0 END), 6) / {total} AS combined, list_sort(list(metric) FILTER (rank <= 5)) AS reasons FROM k GROUP BY 1, 2)
SELECT entity, from_index, combined, array_to_string(reasons, ',') AS reasons, row_number() OVER (PARTITION BY entity ORDER BY combined DESC, len(reasons) DESC, from_index) AS rank FROM g WHERE len(reasons) > 0 QUALIFY rank <= 5"""


_M = {"difference": "difference", "distance": "distance", "elapsed": "round(end_seconds - start_seconds, 6)", "after": "after"}
_SCENES = f"""
b AS (SELECT *, difference >= {CUT} AS b, coalesce(sum(CAST(difference >= {CUT} AS INT)) OVER (PARTITION BY entity ORDER BY from_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scene_index FROM t),
sc AS (SELECT entity, scene_index, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, count(*) FILTER (NOT b) + 1 AS sample_count, round_even(avg(difference) FILTER (NOT b), 8) AS mean_difference, round_even(median(difference) FILTER (NOT b), 8) AS median_difference, max(difference) FILTER (NOT b) AS max_difference FROM b GROUP BY 1, 2
 UNION ALL SELECT entity, scene_index + 1, end_seconds, end_seconds, 1, NULL, NULL, NULL FROM b WHERE b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY from_index DESC) = 1 AND end_seconds = (SELECT max(end_seconds) FROM t WHERE t.entity = b.entity))"""

ORACLES = {
    "jon01_pairs": f"WITH {_S} SELECT entity, from_index, to_index, start_seconds, end_seconds, round(difference, 6) AS difference, distance, after, before FROM t",
    "flt02_classified": f"""WITH {_S}, c AS (SELECT *, difference >= {CUT} OR distance >= 9 AS scene, difference <= {STILL} AND distance <= 4 AS still FROM t)
SELECT entity, to_index, scene, still, array_to_string(list_filter([CASE WHEN scene AND difference >= {CUT} THEN 'large_difference' END, CASE WHEN scene AND distance >= 9 THEN 'large_distance' END, CASE WHEN still THEN 'small_difference' END, CASE WHEN still THEN 'small_distance' END], lambda x: x IS NOT NULL), ',') AS rules FROM c""",
    "flt05_motion_class": f"WITH {_S} SELECT entity, to_index, CASE WHEN difference >= {CUT} THEN 'high' WHEN distance <= 3 THEN 'mostly_stationary' ELSE 'moderate' END AS motion FROM t",
    "win01_scenes": f"WITH {_S}, {_SCENES} SELECT * FROM sc",
    "win02_still_runs": f"WITH {_S}, {_islands('t', f'difference <= {STILL}', 'entity')}",
    "win03_quiet_runs": f"WITH {_S}, {_W}, q AS (SELECT entity, window_index AS from_index, start_seconds, end_seconds, rms AS difference FROM w), {_islands('q', 'difference <= 60', 'entity')}",
    "win04_regional_runs": f"WITH {_S}, {_islands('t', f'difference <= {2 * STILL}', 'entity, event_type', 'OR (flag AND coalesce(from_index <> lag(to_index) OVER w, false))', 2)}",
    "win05_windows": f"WITH {_S}, {_W} SELECT entity, window_index, first_sample, sample_count, start_seconds, end_seconds, round(rms, 6) AS rms, round(peak, 6) AS peak, round(mean, 6) AS mean FROM w",
    "win06_thinned": """WITH RECURSIVE s AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS seconds FROM events),
k AS (SELECT entity, sample_index, seconds, 0 AS kept_index FROM s WHERE sample_index = 0
UNION ALL SELECT k.entity, x.sample_index, x.seconds, k.kept_index + 1 FROM k, LATERAL (SELECT s.sample_index, s.seconds FROM s WHERE s.entity = k.entity AND s.sample_index > k.sample_index AND s.seconds + 1e-9 >= k.seconds + 86400 ORDER BY s.sample_index LIMIT 1) x WHERE k.kept_index < 19)
SELECT entity, kept_index, sample_index FROM k""",
    "win08_ranked": _ranked(_M, "count(*)"),
    "win09_ranked_fixed": "SELECT entity, from_index, combined, rank FROM (" + _ranked({"difference": "difference", "distance": "distance", "after": "CASE WHEN distance > 3 THEN after END"}, "3") + ")",
    "win10_jumps": f"""WITH {_S}, {_W}, x AS (SELECT entity, window_index, rms, lead(rms) OVER (PARTITION BY entity ORDER BY window_index) AS nxt FROM w),
y AS (SELECT *, round(greatest(rms, nxt) / greatest(least(rms, nxt), 1e-9), 6) AS ratio, round(abs(rms - nxt), 6) AS change FROM x WHERE nxt IS NOT NULL)
SELECT entity, window_index, ratio FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ratio DESC, change DESC, window_index) AS rank FROM y) WHERE rank <= 5 AND (ratio >= 3 OR change > 0)""",
    "win11_events": f"""WITH RECURSIVE {_S}, {_ANCHOR}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start_seconds, end_seconds, id) AS k FROM a),
m AS (SELECT entity, k, id, 1 AS event, start_seconds AS gs, end_seconds AS ge FROM o WHERE k = 1
UNION ALL SELECT o.entity, o.k, o.id, CASE WHEN j THEN event ELSE event + 1 END, CASE WHEN j THEN gs ELSE o.start_seconds END, CASE WHEN j THEN greatest(ge, o.end_seconds) ELSE o.end_seconds END
FROM (SELECT m.*, o2.id AS oid, greatest(0, o2.start_seconds - m.ge) <= 1800 + 1e-9 AND greatest(m.ge, o2.end_seconds) - m.gs <= 14400 + 1e-9 AS j FROM m JOIN o o2 ON o2.entity = m.entity AND o2.k = m.k + 1) m JOIN o ON o.id = m.oid)
SELECT entity, id, event FROM m""",
    "win13_highlights": f"WITH {_S} SELECT entity, tie, row_number() OVER (PARTITION BY entity ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, value DESC, seconds, tie) AS rank FROM s QUALIFY rank <= 10",
    "win14_balanced": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, event_type ORDER BY value DESC, tie) AS dr FROM s WHERE event_type <> 'view'),
c AS (SELECT *, CASE event_type WHEN 'signup' THEN 3 WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 END AS cap FROM r)
SELECT entity, tie, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN dr = 1 THEN 0 ELSE 1 END, CASE WHEN dr = 1 THEN event_type END NULLS FIRST, value DESC, tie) AS rank FROM c WHERE dr <= cap QUALIFY rank <= 8""",
    "win15_crossings": f"WITH {_S}, c AS (SELECT entity, (value < 50) <> lag(value < 50) OVER (PARTITION BY entity ORDER BY sample_index) AS c FROM s) SELECT entity, round(avg(CAST(c AS INT)), 6) AS crossing_rate FROM c GROUP BY 1",
    "win16_vector_differences": """WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT label, vec_id, round(list_distance(v, p), 4) AS first_difference, round(list_cosine_similarity(v, p), 4) AS cosine FROM v WHERE p IS NOT NULL""",
    "agg25_second_order": """WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
f AS (SELECT label, vec_id, round(list_distance(v, p), 6) AS f FROM v WHERE p IS NOT NULL), g AS (SELECT label, f - lag(f) OVER (PARTITION BY label ORDER BY vec_id) AS x FROM f)
SELECT label, count(x) AS n, round(avg(x), 3) AS mean, round(coalesce(stddev_samp(x), 0), 3) AS deviation FROM g WHERE x IS NOT NULL GROUP BY 1""",
    "win18_ids": f"WITH {_S}, {_ANCHOR} SELECT id, format('cand-{{:05d}}', row_number() OVER (PARTITION BY entity ORDER BY start_seconds, id)) AS candidate_id FROM a",
    "win19_order_violations": "SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before_value FROM events QUALIFY value <= before_value",
    "jon08_band": f"WITH {_S}, {_ANCHOR} SELECT a.entity, a.id AS l_id, u.id AS r_id FROM a JOIN u ON a.entity = u.entity AND abs(a.start_seconds - u.start_seconds) <= 900 + 1e-9",
    "jon09_best_event": f"WITH {_S}, {_ANCHOR} SELECT entity, l_id, r_id FROM p QUALIFY row_number() OVER (PARTITION BY entity, l_id ORDER BY round(greatest(0, o), 6) DESC, round(round(greatest(0, o), 6) / shorter, 6) DESC, round(mid, 6), rs, r_id) = 1",
    "jon10_context": f"WITH {_S}, {_ANCHOR} SELECT entity, l_id, r_id, round(greatest(0, o), 3) AS overlap, round(greatest(0, -o), 3) AS gap FROM p",
    "evd03_unmatched": f"WITH {_S}, {_ANCHOR} SELECT entity, id FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_id = u.id)",
    "jon07_scene_of": f"WITH {_S}, {_SCENES} SELECT t.entity, t.to_index, min(sc.scene_index) AS scene_index FROM t JOIN sc ON sc.entity = t.entity AND t.start_seconds BETWEEN sc.start_seconds AND sc.end_seconds GROUP BY 1, 2",
    "agg03_coverage": f"WITH {_S} SELECT entity, min(seconds) AS first, max(seconds) AS last, round(greatest(0, least(1, (max(seconds) - min(seconds)) / (30 * 86400))), 6) AS coverage FROM s GROUP BY 1",
    "agg02_summary": f"WITH {_S} SELECT entity, count(*) AS n, count(*) FILTER (difference >= {CUT} OR distance >= 9) AS scenes, count(*) FILTER (difference <= {STILL} AND distance <= 4) AS stills, round(avg(difference), 6) AS mean, max(difference) AS high FROM t GROUP BY 1",
    "agg28_repeated": "SELECT user_id, value, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
}
