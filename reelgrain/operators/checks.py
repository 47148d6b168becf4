"""Checks of analysis reports and of the tables they hold, observations drawn by rules, and compact reports within a size.

Rules are boolean columns with a name; what fires is a row. Texts of arbitrary JSON are walked once by leaf, in Arrow
batches, since depth and keys are open; everything after that is filters over leaves.

Defined results: null, blank and unparsable texts have no leaves; empty tables give no findings; a pair that refers to a
row that is not there is a finding of its own and is not compared further; numbers are equal within 0.001, null only to null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.functions.scalars import unusual_rate
from reelgrain.operators.validation import FORBIDDEN, absolute_path

LEAVES = "report_id bigint, path string, name string, kind string, number double, text string"
#: Phrases that claim a verdict.
CLAIMS = ("proves the video is ai-generated", "video is definitely manipulated", "tampering is confirmed", "manipulation is confirmed", "ai generation is confirmed", "definitely ai-generated")


def _walk(value, path: str, name: str) -> Iterator[tuple[str, str, str, float | None, str | None]]:
    stack = [(value, path, name)]
    while stack:
        value, path, name = stack.pop()
        if isinstance(value, dict):
            yield path, name, "object", None, None
            stack += [(v, f"{path}.{k}" if path else k, k) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            yield path, name, "array", float(len(value)), None
            stack += [(v, f"{path}[{i}]", name) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, bool) or value is None:
            yield path, name, "flag" if value is not None else "null", None, None if value is None else str(value).lower()
        elif isinstance(value, str):
            yield path, name, "text", None, value
        else:
            yield path, name, "integer" if isinstance(value, int) else "float", float(value) if isinstance(value, float) or abs(value) < 2**1000 else math.inf, None


def json_leaves(df: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """Every node of each text with its path, last key and value; an array has its length as number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LEAVES.split(", ")]
        types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    document = json.loads(text.as_py()) if text.is_valid else None
                except (ValueError, RecursionError):
                    continue
                if document is None:
                    continue
                for node in _walk(document, "", ""):
                    rows.append((k, *node))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return df.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{body}`")).mapInArrow(run, LEAVES)


def text_findings(leaves: DataFrame, banned: Sequence[str] = FORBIDDEN) -> DataFrame:
    """report_id, path, rule of every node that a report may not hold: forbidden keys, numbers that are not finite, negative counts, absolute paths, claims."""
    number, low = F.col("number"), F.lower("text")
    claims = reduce(Column.__or__, (F.contains(low, F.lit(c)) for c in CLAIMS))
    rules = {
        "forbidden key": F.lower("name").isin(*banned) & ~F.contains("path", F.lit("]")), "forbidden key in list": F.lower("name").isin(*banned) & F.contains("path", F.lit("]")),
        "not finite": (F.col("kind") == "float") & (F.isnan(number) | (F.abs(number) == float("inf"))), "negative count": (F.col("kind") == "integer") & F.contains("name", F.lit("count")) & (number < 0),
        "absolute path": F.contains("name", F.lit("path")) & absolute_path(F.col("text")), "claims a verdict": F.col("name").isin("description", "interpretation") & claims,
    }
    return leaves.select("report_id", "path", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))).alias("rule"))


def same(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    """Whether two values are equal: numbers within the tolerance, null only to null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def pair_findings(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity, from_index, to_index, rule of pairs (from_index, to_index, start_seconds, end_seconds) that do not fit the frames (sample_index, seconds) they refer to."""
    at = lambda side: frames.select("entity", F.col("sample_index").alias(f"{side}_index"), F.col("seconds").alias(f"_{side}"), F.lit(True).alias(f"_{side}_there"))
    both = pairs.join(at("from"), ["entity", "from_index"], "left").join(at("to"), ["entity", "to_index"], "left")
    there = F.col("_from_there").isNotNull() & F.col("_to_there").isNotNull()
    unlike = lambda a, b: there & ~F.col(a).eqNullSafe(F.col(b))
    rules = {"unknown frame": ~there, "start differs": unlike("start_seconds", "_from"), "end differs": unlike("end_seconds", "_to"), "not consecutive": there & (F.col("to_index") <= F.col("from_index"))}
    return both.select("entity", "from_index", "to_index", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))).alias("rule"))


def pair_counts(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity, frames, pairs of entities whose pairs are not one fewer than their frames."""
    n = frames.groupBy("entity").agg(F.count(F.lit(1)).alias("frames"))
    m = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("pairs"))
    both = n.join(m, "entity", "full_outer").select("entity", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
    return both.filter(F.col("pairs") != F.greatest(F.col("frames") - 1, F.lit(0)))


def summary_findings(stated: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: float = 0.001) -> DataFrame:
    """keys, name, stated, computed of stated figures that are not what the rows give."""
    names = [c for c in stated.columns if c not in keys and c in computed.columns]
    other = computed.select(*keys, *(F.col(c).alias(f"_{c}") for c in names))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("stated"), F.col(f"_{c}").cast("double").alias("computed")) for c in names))
    return stated.join(other, list(keys), "left").select(*keys, F.inline(cells)).filter(~same(F.col("stated"), F.col("computed"), tolerance))


def interval_findings(df: DataFrame, least: float = 0.0, order: str = "id") -> DataFrame:
    """entity, id, rule of intervals that end before they start, are shorter than allowed, or overlap the one before."""
    before = Window.partitionBy("entity").orderBy("start_seconds", order)
    rows = df.withColumn("_end", F.lag("end_seconds").over(before))
    rules = {"ends before it starts": F.col("end_seconds") < F.col("start_seconds"), "too short": F.col("end_seconds") - F.col("start_seconds") < least, "overlaps the one before": F.col("start_seconds") < F.col("_end"), "no time": F.col("start_seconds").isNull() | F.col("end_seconds").isNull()}
    return rows.select("entity", F.col(order), F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))).alias("rule"))


def time_findings(df: DataFrame, key: str, started: str, completed: str) -> DataFrame:
    """key, rule: times that are missing or no times, and ends before starts."""
    a, b = (F.try_to_timestamp(F.col(c).cast("string")) for c in (started, completed))
    return df.select(key, F.when(a.isNull() | b.isNull(), "time missing or invalid").when(b < a, "completed before started").alias("rule")).filter("rule is not null")


def observations(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]], key: str = "entity", prefix: str = "observation-%03d") -> DataFrame:
    """A row per fired rule of several tables (key, n, start_seconds, end_seconds), numbered within the key: tables in their order, rows in order of n, rules in theirs."""
    rows = []
    for k, (df, rules) in enumerate(parts):
        fired = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule_no"), F.lit(n).alias("type"))) for i, (n, c) in enumerate(rules.items()))))
        rows.append(df.select(key, F.lit(k).alias("part"), "n", "start_seconds", "end_seconds", F.inline(fired)))
    whole = reduce(DataFrame.unionByName, rows)
    number = F.row_number().over(Window.partitionBy(key).orderBy("part", "n", "rule_no"))
    return whole.select(key, F.format_string(prefix, number).alias("observation_id"), "type", "start_seconds", "end_seconds")


def frame_rules(dark: float = 0.98, bright: float = 0.98, sharp: float = 50.0) -> dict[str, Column]:
    return {"likely_near_black_sampled_frame": F.col("dark_pixel_ratio") >= dark, "likely_near_white_sampled_frame": F.col("bright_pixel_ratio") >= bright, "low_sampled_frame_laplacian_variance": F.col("laplacian_variance") < sharp}


def pair_rules(jump: float = 50.0) -> dict[str, Column]:
    return {"near_duplicate_sampled_frames": F.col("near_duplicate"), "large_sampled_frame_change": F.col("large_change"), "significant_brightness_jump": F.col("brightness_jump") >= jump}


def metadata_observations(df: DataFrame, key: str) -> DataFrame:
    """Facts and gaps of a media file's metadata (audio_present, encoders, creation_time, frame_rate, stream_count, video_codec), each with its own id."""
    c = F.col
    has = c("encoder").isNotNull()
    named = [
        (c("audio_present"), "metadata-fact-001", "audio_stream_present"), (~c("audio_present"), "missing-metadata-001", "audio_stream_missing"), (has, "metadata-fact-002", "encoder_tag_present"), (~has, "missing-metadata-002", "encoder_tag_missing"),
        (c("creation_time").isNotNull(), "metadata-fact-003", "creation_time_present"), (c("creation_time").isNull(), "missing-metadata-003", "creation_time_missing"), (unusual_rate(c("frame_rate")), "metadata-fact-004", "unusual_frame_rate_value"), (c("stream_count") > 1, "metadata-fact-005", "multiple_streams"),
        (c("video_codec") == "h264", "metadata-fact-006", "h264_video_codec"), (c("video_codec") != "h264", "metadata-fact-006", "video_codec_present"), (c("video_codec").isNull(), "missing-metadata-004", "video_codec_missing"),
    ]
    fired = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.struct(F.lit(i).alias("observation_id"), F.lit(t).alias("type"))) for x, i, t in named)))
    return df.select(key, F.inline(fired))


def stage_findings(df: DataFrame, key: str) -> DataFrame:
    """key, side, type: what is ambiguous, normal and always missing of an analysis (encoders_missing, audio_transitions, regional_transitions, clipping_ratio, static_intervals, duration_difference)."""
    c = F.col
    named = [
        (c("encoders_missing"), "ambiguous", "missing_encoder_metadata"), (c("audio_transitions") > 0, "ambiguous", "audio_energy_changes"), (c("regional_transitions") > 0, "ambiguous", "regional_visual_variation"),
        (c("clipping_ratio") == 0, "normal", "no_clipping_like_samples"), (F.coalesce("static_intervals", F.lit(0)) == 0, "normal", "no_sustained_near_static_intervals"), (F.coalesce("duration_difference", F.lit(0.0)) == 0, "normal", "duration_metadata_not_inconsistent"),
        *((F.lit(True), "missing", t) for t in ("content_provenance", "trained_ai_video_detector", "generator_watermark_detection", "dataset_calibrated_probability")),
    ]
    fired = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.struct(F.lit(s).alias("side"), F.lit(t).alias("type"))) for x, s, t in named)))
    return df.select(key, F.inline(fired))


def legacy_view(categories: Mapping[str, DataFrame]) -> DataFrame:
    """Observations of several categories as one table of evidence; absent columns are null, no severity is `info`."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn("category", F.lit(n)) for n, d in categories.items()))
    severity = F.coalesce("severity", F.lit("info")) if "severity" in whole.columns else F.lit("info")
    return whole.withColumns({"severity": severity, "evidence_id": F.col("observation_id")})


def public_view(df: DataFrame) -> DataFrame:
    """Without columns whose names begin with an underscore."""
    return df.select(*(f"`{c}`" for c in df.columns if not c.startswith("_")))


def run_counters(videos: DataFrame) -> DataFrame:
    """One row of counters of a batch run (label, copied, duplicate, analysed, registered, existing per video)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    c = F.col
    return videos.agg(
        F.count(F.lit(1)).alias("discovered"), n(c("label") == "real").alias("resolved_real"), n(c("label") == "ai_generated").alias("resolved_ai"), F.count_if(c("label").isNull()).alias("unresolved"), n(c("copied")).alias("copied"), n(c("duplicate")).alias("duplicates"),
        n(c("analysed")).alias("analysed"), n(~c("analysed")).alias("failed"), n(c("registered")).alias("registered"), n(c("existing")).alias("skipped_existing"),
    )


#: Caps from the fullest report to the smallest: artifacts, findings and events shown, short texts, optional metrics left out.
RUNGS = tuple([(a, 5, 5, False, False) for a in (4, 3, 2, 1, 0)] + [(0, f, 5, False, False) for f in (4, 3)] + [(0, 3, e, False, False) for e in (4, 3, 2, 1)] + [(0, 3, 1, True, False), (0, 3, 1, True, True)])


def compact_reports(events: DataFrame, preferred: int = 8000, hard: int = 16000, rungs: Sequence[tuple] = RUNGS) -> DataFrame:
    """entity, rung, bytes, fits, report: the fullest rendering of each entity's events that fits in `preferred` bytes, else the smallest.

    events: entity, place (from 1, at most five count), summary, metrics, findings (array of structs with a summary), artifacts
    (array of texts); each entity's events are few by their caps and are gathered into one array.
    """
    item = F.struct("place", "summary", "metrics", "findings", "artifacts")
    held = events.filter(F.col("place") <= 5).groupBy("entity").agg(F.array_sort(F.collect_list(item), lambda a, b: a["place"] - b["place"]).alias("e"))
    short = lambda text, on: F.substring(text, 1, 40) if on else text

    def rendered(artifacts: int, findings: int, count: int, concise: bool, bare: bool) -> Column:
        one = lambda x: F.struct(
            x["place"].alias("place"), short(x["summary"], concise).alias("summary"), *([] if bare else [x["metrics"].alias("metrics")]),
            F.transform(F.slice(x["findings"], 1, findings), lambda f: f.withField("summary", short(f["summary"], concise))).alias("findings"), *([F.slice(x["artifacts"], 1, artifacts).alias("artifacts")] if artifacts else []),
        )
        return F.to_json(F.struct(F.transform(F.slice("e", 1, count), one).alias("events")))

    texts = F.array(*(F.struct(F.lit(i).alias("rung"), rendered(*r).alias("report")) for i, r in enumerate(rungs)))
    sized = held.select("entity", F.transform(texts, lambda t: F.struct(t["rung"].alias("rung"), F.octet_length(t["report"]).alias("bytes"), t["report"].alias("report"))).alias("t"))
    chosen = F.coalesce(F.get(F.filter("t", lambda t: t["bytes"] <= preferred), F.lit(0)), F.element_at("t", -1))
    return sized.select("entity", chosen.alias("c")).select("entity", "c.rung", "c.bytes", (F.col("c.bytes") <= hard).alias("fits"), "c.report")


def compact_findings(reports: DataFrame, most_events: int = 5, hard: int = 16000, banned: Sequence[str] = FORBIDDEN) -> DataFrame:
    """entity, rule of compact reports that are too large, hold too many events, or hold what no report may."""
    n = F.size(F.from_json("report", "events array<string>")["events"])
    rules = {"too large": F.col("bytes") > hard, "too many events": n > most_events, "no events": n < 0, "forbidden key": reduce(Column.__or__, (F.contains("report", F.lit(f'"{b}":')) for b in banned)), "not finite": F.col("report").rlike(r":(NaN|-?Infinity)")}
    return reports.select("entity", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), x) for x, c in rules.items())))).alias("rule"))
