"""Queries of streams, readers and writers: each goes through files in the shared folder and gives what the batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.operators import sequence, signals
from reelgrain.session import scratch, table
from reelgrain.sources import files, sinks
from reelgrain.streaming import streams as st


def _events(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream, with a last row far ahead that closes every window."""
    path = scratch(s, "events")
    rows = table(s, d, "events")
    rows.write.parquet(f"{path}/1")
    rows.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{path}/2")
    return s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)


def _windowed(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.windowed(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))), scratch(s, "stream"), "windows")
    return out.filter("event_type <> 'end'").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def _sessions(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.sessions(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))), scratch(s, "stream"), "sessions")
    return out.filter("user_id >= 0").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _thinned(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.thinned(_events(s, d), 86400.0), scratch(s, "stream"), "thinned")
    return out.filter("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _arrivals(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.distinct_arrivals(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"]), scratch(s, "stream"), "arrivals")
    return out.filter("user_id >= 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _ledger(s: SparkSession, d: str) -> DataFrame:
    """The manifest as a stream of two deliveries, the second of everything again, into one ledger; then the stream once more. Their files follow their size."""
    folder, rows = scratch(s, "ledger"), table(s, d, "manifest").select("sample_id", "batch_no")
    for k in range(2):
        rows.hint("rebalance").write.parquet(f"{folder}/in/{k}")
    stream = lambda: s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for run in range(2):
        st.into_ledger(stream(), f"{folder}/out", "sample_id", f"{folder}/marks{run}")
    return s.read.parquet(f"{folder}/out").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.flagged_runs(_events(s, d), 50.0), scratch(s, "stream"), "runs")
    return out.filter("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"), F.max("n").alias("longest"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.merged(_events(s, d), 86400.0, 3 * 86400.0), scratch(s, "stream"), "merged")
    return out.filter("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.max("n").alias("largest"))


def _guarded(s: SparkSession, d: str) -> DataFrame:
    out = st.to_table(st.guarded_times(_events(s, d)), scratch(s, "stream"), "guarded")
    return out.filter("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "previous").alias("held_back"))


def _csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(s, 'export')}.csv"
    sinks.export_csv(table(s, d, "manifest").select("entry_id", "sample_id", "batch_no", "feature_schema_version"), path, "entry_id")
    return files.feature_table(s, path).select(F.col("entry_id").cast("bigint").alias("entry_id"), "sample_id", F.col("batch_no").cast("int").alias("batch_no"), "feature_schema_version")


def _jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(s, 'export')}.jsonl"
    rows = table(s, d, "outcome_features").dropDuplicates(["record_id"]).select("record_id", "load_no", F.col("frame_summary.mean_sharpness").alias("sharpness"))
    sinks.export_jsonl(rows, path, "record_id")
    return files.feature_table(s, path).select("record_id", F.col("load_no").cast("int").alias("load_no"), "sharpness")


def _grid(s: SparkSession, d: str) -> DataFrame:
    t = sequence.transitions(sequence.samples(table(s, d, "events")))
    return signals.across_grid(t.select("entity", "to_index", "difference")).withColumn("part", F.round(F.col("difference") * (F.col("row") + 1) / (F.col("column") + 1), 6)).groupBy("entity", "region_id").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("high"))


QUERIES = {
    "stm01_windows": _windowed,
    "stm02_sessions": _sessions,
    "stm03_thinned": _thinned,
    "stm04_arrivals": _arrivals,
    "stm04_ledger": _ledger,
    "stm02_flagged_runs": _runs,
    "stm03_merged": _merged,
    "stm05_guarded_times": _guarded,
    "snk06_csv": _csv_round_trip,
    "snk07_jsonl": _jsonl_round_trip,
    "jon06_grid": _grid,
}

ORACLES = {
    "stm01_windows": """WITH w AS (SELECT UNNEST([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start, event_type, value FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2""",
    "stm02_sessions": """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL '6 hours' AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(CAST(coalesce(gap, true) AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, run""",
    "stm03_thinned": """WITH RECURSIVE k AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
UNION ALL SELECT k.user_id, x.ts FROM k, LATERAL (SELECT min(e.ts) AS ts FROM events e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL '86400 seconds') x WHERE x.ts IS NOT NULL) SELECT user_id, count(*) AS n FROM k GROUP BY 1""",
    "stm04_arrivals": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stm04_ledger": "SELECT DISTINCT sample_id, 1 AS n FROM manifest WHERE sample_id IS NOT NULL",
    "stm02_flagged_runs": """WITH f AS (SELECT user_id, ts, event_id, value <= 50 AS f FROM events), g AS (SELECT *, coalesce(sum(CAST(NOT f AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS g FROM f),
r AS (SELECT user_id, g, count(*) AS n FROM g WHERE f GROUP BY 1, 2) SELECT user_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n, max(n) AS longest FROM r GROUP BY 1""",
    "stm03_merged": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT user_id, k, 1 AS g, s AS a, s AS b FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN a ELSE o.s END, o.s FROM (SELECT m.*, o2.s AS s2, o2.s - m.b <= 86400 + 1e-9 AND o2.s - m.a <= 259200 + 1e-9 AS j FROM m JOIN o o2 ON o2.user_id = m.user_id AND o2.k = m.k + 1) m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1),
c AS (SELECT user_id, g, count(*) AS n FROM m GROUP BY 1, 2) SELECT user_id, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, max(n) AS largest FROM c GROUP BY 1""",
    "stm05_guarded_times": "WITH m AS (SELECT user_id, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (back) AS held_back FROM m GROUP BY 1",
    "snk06_csv": "SELECT entry_id, sample_id, batch_no, feature_schema_version FROM manifest",
    "snk07_jsonl": "SELECT DISTINCT record_id, load_no, CASE WHEN NOT isnan(frame_summary.mean_sharpness) THEN frame_summary.mean_sharpness END AS sharpness FROM outcome_features",
    "jon06_grid": """WITH t AS (SELECT user_id AS entity, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS difference FROM events QUALIFY difference IS NOT NULL),
x AS (SELECT entity, r, c, round(difference * (r + 1) / (c + 1), 6) AS part FROM t, range(4) a(r), range(4) b(c)) SELECT entity, format('region-r{:02d}-c{:02d}', r, c) AS region_id, count(*) AS n, max(part) AS high FROM x GROUP BY 1, 2""",
}
