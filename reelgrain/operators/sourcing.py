"""Metadata files of other collections: fuzzy columns to normalised records, audits, plans and their checks.

Lines come as texts with their file (see rejects.py for headers and fields). Column names are matched by parts; of several
that match, the first one that is not blank counts for a row. All figures of an audit are aggregates.

Defined results. Lines that are not well quoted or have another number of fields than their header keep the fields that
they have; a missing field is blank. Labels are read by synonyms, anything else is unmapped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.functions import scalars as sc
from reelgrain.operators.rejects import SPACE, fields_by_header
from reelgrain.operators.validation import unsafe_path

#: Parts of column names, and spellings of the two labels.
PARTS = {
    "path": ("path", "file", "video"), "label": ("label", "class", "category", "target", "type"), "method": ("manipulation", "method", "attack", "generator"), "compression": ("compression", "quality", "level"),
    "frames": ("frame",), "width": ("width",), "height": ("height",), "codec": ("codec",), "size": ("size",),
}
REAL = ("real", "original", "authentic", "pristine", "0")
GENERATED = ("fake", "manipulated", "ai_generated", "ai-generated", "synthetic", "generated", "deepfake", "1")
VIDEO, STILL = (".mp4", ".mov", ".avi", ".mkv", ".webm"), (".jpg", ".jpeg", ".png", ".bmp", ".webp")
PLAN_FIELDS = ("plan_index", "source_dataset", "metadata_source_file", "source_row_id", "video_name", "expected_label", "selection_seed", "video_available")


def label(c: Column) -> Column:
    low = F.lower(F.btrim(c, F.lit(SPACE)))
    return F.when(low.isin(*REAL), "real").when(low.isin(*GENERATED), "ai_generated")


def first_named(cells: Column, parts: Sequence[str]) -> Column:
    """The first value that is not blank among the (name, value) cells whose name holds one of the parts."""
    named = lambda x: reduce(Column.__or__, (F.contains(F.replace(F.lower(x["name"]), F.lit(" "), F.lit("_")), F.lit(p)) for p in parts))
    held = F.filter(cells, lambda x: named(x) & (F.coalesce(F.btrim(x["value"], F.lit(SPACE)), F.lit("")) != ""))
    return F.btrim(F.get(held, F.lit(0))["value"], F.lit(SPACE))


def normalised(lines: DataFrame) -> DataFrame:
    """A record per line that is no header: where it comes from, its path and name, labels, method, sizes."""
    rows = fields_by_header(lines)
    picked = rows.select("raw_id", "file_name", "line_no", "cells", *(first_named(F.col("cells"), parts).alias(f"_{k}") for k, parts in PARTS.items()))
    path = F.replace(F.col("_path"), F.lit("\\"), F.lit("/"))
    unsafe = F.coalesce(unsafe_path(path), F.lit(False))
    digits = lambda c: F.when(F.col(c).rlike(r"^[+-]?\d+$"), F.col(c).try_cast("bigint"))
    return picked.select(
        "raw_id", "file_name", (F.col("line_no") - 1).alias("source_row_id"), sc.base_name(F.col("_path")).alias("video_name"), F.when(~unsafe, path).alias("source_video_path"), unsafe.alias("path_invalid"),
        label(F.col("_label")).alias("normalised_label"), F.col("_label").alias("original_label"), F.col("_method").alias("manipulation_method"), F.col("_compression").alias("compression"),
        digits("_frames").alias("frame_count"), digits("_width").alias("width"), digits("_height").alias("height"), F.col("_codec").alias("codec"), F.col("_size").try_cast("double").alias("file_size_mb"), F.col("_path").alias("written_path"), "cells",
    )


def availability(records: DataFrame, listing: DataFrame) -> DataFrame:
    """records with status and resolved_path: a listed path is meant by its whole path or by its name, whatever its folder."""
    paths = listing.select("path", F.lower(sc.base_name(F.col("path"))).alias("_name")).distinct()
    by_name = paths.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_path"))
    joined = records.withColumn("_name", F.lower("video_name")).join(by_name, "_name", "left")
    untrusted = F.col("normalised_label").isNull() | F.col("video_name").isNull() | F.col("path_invalid")
    status = F.when(untrusted, "invalid_metadata").when(F.col("_n").isNull(), "video_missing").when(F.col("_n") > 1, "ambiguous_video_match").otherwise("video_found")
    return joined.withColumn("status", status).withColumn("resolved_path", F.when(F.col("status") == "video_found", F.col("_path"))).drop("_name", "_n", "_path")


def path_style(paths: Column) -> Column:
    """An aggregate: the style that the paths of a group show, the most telling first."""
    shows = lambda pattern: F.bool_or(paths.rlike(pattern))
    return F.when(shows(r"^[A-Za-z]:[\\/]"), "windows_absolute").when(shows(r"^/"), "unix_absolute").when(shows(r"\\"), "windows_relative").when(shows("/"), "unix_relative").when(F.count(paths) > 0, "filename_only").otherwise("unknown")


def row_representation(paths: Column) -> Column:
    """An aggregate: whether rows are videos or extracted frames, by their suffixes."""
    suffix = sc.suffix(paths)
    return F.when(F.bool_or(suffix.isin(*VIDEO)), "videos").when(F.bool_or(suffix.isin(*STILL)), "extracted_frames").otherwise("unknown")


def audit(lines: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """A row per file: rows, repeated rows and paths, labels, trusted labels, methods, representation, path style and availability."""
    rows = normalised(lines)
    if listing is not None:
        rows = availability(rows, listing)
    content = F.sha2(F.to_json(F.transform("cells", lambda x: F.coalesce(F.btrim(x["value"], F.lit(SPACE)), F.lit(""))), {"ignoreNullFields": "false"}), 256)
    counted = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    figures = rows.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("written_path").alias("_paths"), path_style(F.col("written_path")).alias("path_style"), row_representation(F.col("written_path")).alias("row_representation"),
        counted(F.col("normalised_label") == "real").alias("real"), counted(F.col("normalised_label") == "ai_generated").alias("ai_generated"), F.count_if(F.col("normalised_label").isNull()).alias("unmapped"),
        *([counted(F.col("status") == x).alias(x) for x in ("video_found", "video_missing", "ambiguous_video_match", "invalid_metadata")] if listing is not None else []),
    )
    # distinct counts by their own partial aggregates, not by collected sets
    apart = lambda c, name: rows.select("file_name", c.alias("v")).filter("v is not null").distinct().groupBy("file_name").agg(F.count(F.lit(1)).alias(name))
    for c, name in ((content, "_contents"), (F.col("written_path"), "_distinct_paths"), (F.col("manipulation_method"), "methods"), (F.col("original_label"), "labels")):
        figures = figures.join(apart(c, name), "file_name", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return figures.withColumns({"duplicate_rows": F.col("rows") - none("_contents"), "duplicate_paths": F.col("_paths") - none("_distinct_paths"), "methods": none("methods"), "labels": none("labels")}).drop("_paths", "_contents", "_distinct_paths")


def column_audit(lines: DataFrame) -> DataFrame:
    """file_name, column_name, missing, inferred type of every column of every file."""
    cells = normalised(lines).select("file_name", F.inline("cells"))
    v = F.btrim("value", F.lit(SPACE))
    there = F.coalesce(v, F.lit("")) != ""
    whole, number = v.rlike(r"^[+-]?\d+$"), v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    flags = F.lower(v).isin("true", "false", "0", "1", "yes", "no")
    all_are = lambda c: F.bool_and(F.when(there, c))
    kind = F.when(F.count_if(there) == 0, "empty").when(all_are(whole), "integer").when(all_are(number), "number").when(all_are(flags), "boolean_like").otherwise("string")
    return cells.groupBy("file_name", F.col("name").alias("column_name")).agg(F.count_if(~there).alias("missing"), kind.alias("inferred_type"))


def plan(records: DataFrame, wanted: Mapping[str, int], seed: int = 42) -> DataFrame:
    """wanted rows of each label: found videos first, methods in turn, each name and path once; plan_index follows label, method, name and row.

    Within a method rows are in order of a hash of seed and row, found ones before others, so that the choice is the same for
    a seed and even over methods.
    """
    rows = records.filter(F.col("normalised_label").isin(*wanted)).withColumn("_method", F.coalesce("manipulation_method", F.lit("unknown")))
    rows = rows.withColumn("_late", (F.col("status") != "video_found").cast("int")).withColumn("_h", F.xxhash64(F.lit(seed), "raw_id"))
    # a name, then a path, stands for the first of its rows: folded before the shuffle
    whole = F.struct(*(F.col(c) for c in rows.columns))
    for key in ("video_name", "resolved_path"):
        alone = rows.filter(F.col(key).isNull())
        once = rows.filter(F.col(key).isNotNull()).groupBy("normalised_label", key).agg(F.min_by(whole, F.struct("_late", "_h", "raw_id")).alias("r")).select("r.*")
        rows = once.unionByName(alone)
    turn = F.row_number().over(Window.partitionBy("normalised_label", "_method").orderBy("_late", "_h", "raw_id"))
    most = reduce(lambda c, x: c.when(F.col("normalised_label") == x[0], x[1]), wanted.items(), F.when(F.lit(False), 0))
    few = rows.withColumn("_turn", turn).filter(F.col("_turn") <= most)  # at most the wanted number of each method
    rank = F.row_number().over(Window.partitionBy("normalised_label").orderBy("_turn", "_method", "raw_id"))
    chosen = few.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    index = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("normalised_label", F.coalesce("manipulation_method", F.lit("")), F.coalesce("video_name", F.lit("")), "source_row_id", "raw_id"))  # the plan: as many rows as wanted
    return chosen.select(index.alias("plan_index"), "raw_id", "file_name", "source_row_id", "video_name", "resolved_path", F.col("normalised_label").alias("expected_label"), "original_label", "manipulation_method", "compression", F.lit(seed).alias("selection_seed"), (F.col("status") == "video_found").alias("video_available"))


def shortages(chosen: DataFrame, wanted: Mapping[str, int]) -> DataFrame:
    """label, wanted, chosen and short of a plan."""
    asked = chosen.sparkSession.createDataFrame(list(wanted.items()), "expected_label string, wanted int")
    n = chosen.groupBy("expected_label").agg(F.count(F.lit(1)).alias("chosen"))
    got = F.coalesce("chosen", F.lit(0))
    return F.broadcast(asked).join(n, "expected_label", "left").select("expected_label", "wanted", got.alias("chosen"), F.greatest(F.col("wanted") - got, F.lit(0)).alias("short"))


def plan_findings(entries: DataFrame, listing: DataFrame, order: str = "line_no") -> DataFrame:
    """order, rule of every rule that a plan entry breaks: fields, rising indexes, labels, unsafe, repeated or vanished paths."""
    there = listing.select(F.col("path").alias("resolved_path"), F.lit(True).alias("_there")).distinct()
    before = F.max("plan_index").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))  # a plan is as small as what it asks for
    firsts = entries.filter("resolved_path is not null").groupBy("resolved_path").agg(F.min(order).alias("_first"))
    rows = entries.withColumn("_before", before).join(firsts, "resolved_path", "left").join(there, "resolved_path", "left")
    path = F.col("resolved_path")
    rules = {
        **{f"lacks {c}": F.col(c).isNull() for c in PLAN_FIELDS}, "index not rising": F.col("plan_index") <= F.col("_before"), "label invalid": ~F.coalesce(F.col("expected_label").isin("real", "ai_generated"), F.lit(False)),
        "path unsafe": unsafe_path(path), "path repeated": F.col("_first") < F.col(order), "video vanished": path.isNotNull() & F.col("video_available") & F.col("_there").isNull(),
    }
    return rows.select(order, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))).alias("rule"))
