"""Deeply nested JSON records to related flat tables.

The JVM reads each polymorphic level of the text once (`from_json` with string leaves keeps whatever shape was
delivered), so that what reaches Python is Arrow list columns. The flattening itself works on the Arrow buffers: list
offsets give places, parent indices give links, keys follow by `take`; no row is visited in Python.

Defined results. A null, blank or unparsable body has no objects. A single object in place of an array is an array of
one. Text that spells JSON counts as what it spells. Null entries keep their place and are no objects; entries of
transitions, events and findings that are not objects are dropped but keep their place; artifact references may be
objects or non-blank bare strings. Repeated deliveries give repeated rows here (`found` removes them).
Columns of the input other than `key` and `body` are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.scalars import number, whole_number

KINDS = ("notable_transition", "event", "finding", "artifact_reference")
OUT = "report_id bigint, kind string, event_pos int, finding_pos int, pos int, object string"


def _array_of(text: Column) -> Column:
    """JSON text of an array, or of one thing, as an array of texts."""
    head = F.substring(F.ltrim(text), 1, 1)
    return F.when(head == "[", F.from_json(text, "array<string>")).when(text.isNotNull() & (head != ""), F.array(text))


def _object(text: Column) -> Column:
    """The text if it spells an object, else null."""
    return F.when(F.substring(F.ltrim(text), 1, 1) == "{", text)


def _finding(text: Column) -> Column:
    return F.struct(_object(text).alias("o"), _array_of(F.from_json(_object(text), "artifact_references string")["artifact_references"]).alias("a"))


def _event(text: Column) -> Column:
    parts = F.from_json(_object(text), "findings string, artifact_references string")
    return F.struct(
        _object(text).alias("o"),
        _array_of(parts["artifact_references"]).alias("a"),
        F.transform(_array_of(parts["findings"]), _finding).alias("f"),
    )


def nested_lists(df: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """key, notable transitions, events (with findings and references) and ambiguous findings as typed lists."""
    top = F.from_json(F.col(body), "temporal_analysis string, temporal string, unified_evidence string")
    sections = df.select(
        F.col(key).cast("bigint").alias("k"),
        F.coalesce(top["temporal_analysis"], top["temporal"]).alias("t"),
        top["unified_evidence"].alias("u"),
    )
    parts = sections.select(
        "k",
        F.from_json("t", "notable_transitions string")["notable_transitions"].alias("n"),
        F.from_json("u", "events string, ambiguous_findings string").alias("u"),
    )
    return parts.select(
        "k",
        _array_of(F.col("n")).alias("n"),
        F.transform(_array_of(F.col("u.events")), _event).alias("e"),
        F.transform(_array_of(F.col("u.ambiguous_findings")), _finding).alias("m"),
    )


def _children(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The entries of a list column, each one's parent and its place in the parent, from offsets alone."""
    lists = lists if lists.type == pa.list_(lists.type.value_type) else lists.cast(pa.list_(lists.type.value_type))
    parent = pc.list_parent_indices(lists).cast(pa.int64())
    starts = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
    first = pc.subtract(pc.cumulative_sum(starts), starts)
    place = pc.subtract(pa.array(np.arange(len(parent))), first.take(parent))
    return pc.list_flatten(lists), parent, place.cast(pa.int32())


def _rows(kind: str, key: pa.Array, event: pa.Array | None, finding: pa.Array | None, place: pa.Array, text: pa.Array) -> pa.RecordBatch:
    n = len(place)
    minus = pa.array([-1], pa.int32()).take(pa.array([0], pa.int64()).take(pa.nulls(n, pa.int64()).fill_null(0)))
    out = pa.RecordBatch.from_arrays(
        [key, pa.array([kind]).take(pa.nulls(n, pa.int64()).fill_null(0)), minus if event is None else event, minus if finding is None else finding, place, text],
        names=["report_id", "kind", "event_pos", "finding_pos", "pos", "object"],
    )
    blank = pc.equal(pc.utf8_trim_whitespace(pc.fill_null(text, "")), "")
    return out.filter(pc.and_(pc.is_valid(text), pc.invert(blank)))


def flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("k")
        text, parent, place = _children(batch.column("n"))
        spelled = pc.starts_with(pc.utf8_ltrim_whitespace(text), "{")
        yield _rows("notable_transition", key.take(parent), None, None, place, pc.if_else(spelled, text, pa.scalar(None, pa.string())))

        events, parent, event_place = _children(batch.column("e"))
        event_key = key.take(parent)
        yield _rows("event", event_key, event_place, None, event_place, events.field("o"))
        text, parent, place = _children(events.field("a"))
        yield _rows("artifact_reference", event_key.take(parent), event_place.take(parent), None, place, text)
        findings, parent, finding_place = _children(events.field("f"))
        finding_key, finding_event = event_key.take(parent), event_place.take(parent)
        yield _rows("finding", finding_key, finding_event, None, finding_place, findings.field("o"))
        text, parent, place = _children(findings.field("a"))
        yield _rows("artifact_reference", finding_key.take(parent), finding_event.take(parent), finding_place.take(parent), place, text)

        findings, parent, finding_place = _children(batch.column("m"))
        finding_key = key.take(parent)
        yield _rows("finding", finding_key, None, None, finding_place, findings.field("o"))
        text, parent, place = _children(findings.field("a"))
        yield _rows("artifact_reference", finding_key.take(parent), None, finding_place.take(parent), place, text)


def flatten_reports(df: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """One row per object of a body: key, kind, places of its parents, its own place and its text."""
    return nested_lists(df, key, body).mapInArrow(flatten_batches, OUT)


def objects(df: DataFrame, key: str = "report_id", body: str = "body") -> DataFrame:
    """The distinct objects by place, without their text."""
    return flatten_reports(df, key, body).select("report_id", "kind", "event_pos", "finding_pos", "pos").distinct()


def _fields(names: str) -> Column:
    """The object's fields as a struct of texts, whatever their shape."""
    return F.from_json("object", ", ".join(f"{n} string" for n in names.split()))


def _texts(text: Column) -> Column:
    """An array of texts, or of one."""
    return F.coalesce(_array_of(text), F.array().cast("array<string>"))


def transitions_table(df: DataFrame) -> DataFrame:
    """The notable transitions with their fields, linked to their report. Numbers may be written as text; what is none is null."""
    o = lambda n: F.col(f"o.{n}")
    inner = lambda part, n: number(F.get_json_object(o(part), f"$.{n}"))
    rows = flatten_reports(df).filter("kind = 'notable_transition'").withColumn("o", _fields("transition_id from_sample_index to_sample_index start_timestamp_seconds end_timestamp_seconds metrics optical_flow notability"))
    return rows.select(
        "report_id", "pos", o("transition_id").alias("transition_id"), *(whole_number(o(c)).alias(c) for c in ("from_sample_index", "to_sample_index")), *(number(o(c)).alias(c) for c in ("start_timestamp_seconds", "end_timestamp_seconds")),
        inner("metrics", "perceptual_hash_distance").alias("perceptual_hash_distance"), inner("metrics", "histogram_correlation").alias("histogram_correlation"), inner("optical_flow", "mean_magnitude").alias("mean_magnitude"), inner("optical_flow", "stationary_pixel_ratio").alias("stationary_pixel_ratio"),
        o("notability").alias("notability"),
    ).distinct()


def events_table(df: DataFrame) -> DataFrame:
    """The evidence events with their fields, linked to their report."""
    rows = flatten_reports(df).filter("kind = 'event'").withColumn("o", _fields("event_id start_timestamp_seconds end_timestamp_seconds evidence_domains"))
    return rows.select("report_id", "pos", F.col("o.event_id").alias("event_id"), *(number(F.col(f"o.{c}")).alias(c) for c in ("start_timestamp_seconds", "end_timestamp_seconds")), _texts(F.col("o.evidence_domains")).alias("evidence_domains")).distinct()


def findings_table(df: DataFrame) -> DataFrame:
    """The findings with their fields, linked to report and event (-1: ambiguous). Metrics that are no numbers are null."""
    rows = flatten_reports(df).filter("kind = 'finding'").withColumn("o", _fields("candidate_id domain type summary metrics source_observation_ids"))
    metrics = F.transform_values(F.from_json("o.metrics", "map<string,string>"), lambda k, v: number(v))
    pairs = F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return rows.select("report_id", "event_pos", "pos", *(F.col(f"o.{c}").alias(c) for c in ("candidate_id", "domain", "type", "summary")), pairs.alias("metrics"), _texts(F.col("o.source_observation_ids")).alias("source_observation_ids")).distinct()


def artifacts_table(df: DataFrame) -> DataFrame:
    """The artifact references with their fields, linked to report, event and finding; a bare text is a path."""
    rows = flatten_reports(df).filter("kind = 'artifact_reference'")
    spelled = F.startswith(F.ltrim("object"), F.lit("{"))
    o = F.when(spelled, _fields("path role size_bytes sha256 label"))
    return rows.select("report_id", "event_pos", "finding_pos", "pos", F.when(spelled, o["path"]).otherwise(F.col("object")).alias("path"), o["role"].alias("role"), o["label"].alias("label"), whole_number(o["size_bytes"]).alias("size_bytes"), o["sha256"].alias("sha256")).distinct()
