"""Profiles of every column of a flat labelled table: counts, modes, quality, eligibility for a model, and tables drawn from them.

Cells are unpivoted and counted once by (column, value), with partial counts before the shuffle; a profile row, its quality
and all reports follow from these counts. Nothing is ranked over a column: modes and heads are aggregates.

Defined results: an empty table gives no rows; null, NaN and the missing words in any case are missing; infinities and text
that holds a digit but is no number are invalid; ties of modes go to the smaller value; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.functions import scalars as sc
from reelgrain.functions.text import present_lower
from reelgrain.operators.audit import SOURCE_TERMS
from reelgrain.session import written

CLASSES = ("real", "ai_generated")
#: Tokens of column names whose values may not be negative, or not leave [0, 1]. Names are cut at anything but a-z and 0-9.
NOT_NEGATIVE, SHARES = ("duration", "width", "height", "count", "sample"), ("ratio", "percentage")


def cells(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """label, column_name, number, text, state of every cell; state is missing, numeric, invalid or other. Cells are unpivoted first and judged after it, by one set of expressions."""
    types, parts = dict(df.dtypes), []
    for c in columns:
        x, none = F.col(f"`{c}`"), F.lit(None)
        number = types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[c].startswith("decimal")
        text = F.initcap(x.cast("string")) if types[c] == "boolean" else x.cast("string")
        parts.append(F.struct(F.lit(c).alias("column_name"), (x if number else none).cast("double").alias("number"), (none.cast("string") if number else text).alias("text")))
    long = df.select(F.col(f"`{target}`").alias("label"), F.inline(F.array(*parts)))
    n, kind = F.col("number"), sc.number_kind(F.col("text"))
    of_number = F.when(n.isNull() | F.isnan(n), None).when(F.abs(n) == float("inf"), "invalid").otherwise("numeric")
    of_text = F.when(present_lower(F.col("text")).isNull(), None).when(kind == "numeric", "numeric").when(kind == "invalid_numeric", "invalid").otherwise("other")
    judged = long.withColumn("state", F.coalesce(of_number, of_text, F.lit("missing")))
    there = F.col("state") != "missing"
    value = F.when(F.col("text").isNull(), n).when(F.col("state") == "numeric", F.btrim("text").try_cast("double"))
    return judged.select("label", "column_name", F.when(there, value).alias("number"), F.when(there, F.col("text")).alias("text"), "state")


def cell_counts(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Cells counted by (column, value), over all rows and in each class: what everything below is drawn from, written once."""
    counts = cells(df, columns, target).groupBy("column_name", "state", "number", "text").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES))
    return written(counts, "cells")


def impossible(column: Column, number: Column) -> Column:
    """What the column's name rules out of a number: `negative`, `outside_share` or null."""
    tokens = F.split(F.lower(column), "[^a-z0-9]+")
    has = lambda terms: F.arrays_overlap(tokens, F.array(*map(F.lit, terms)))
    return F.when(has(NOT_NEGATIVE) & (number < 0), "negative").when(has(SHARES) & ((number < 0) | (number > 1)), "outside_share")


def category(name: Column, kind: Column) -> Column:
    """The meaning of a column by its name, then by its type; the first rule that applies."""
    low = F.lower(name)
    has = lambda *words: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))
    ends = lambda *words: reduce(Column.__or__, (F.endswith(low, F.lit(w)) for w in words))
    return (
        F.when(kind == "empty", "fully_empty")
        .when(name == "expected_label", "target")
        .when(has("label", "verdict", "classification"), "possible_leakage")
        .when(has("path", "file", "video_name") | ends(".name", "_name"), "path")
        .when((low == "sample_id") | ends("sha256", ".analysis_id"), "identifier")
        .when(ends("_at") | has("timestamp", "creation_time"), "timestamp")
        .when(low.isin("source", "notes") | has("generator", "camera"), "source_metadata")
        .when(has("schema_version", "application_version", "calibration", "score_direction") | F.startswith(low, F.lit("d3_summary.d3_encoder")) | F.startswith(low, F.lit("d3_summary.d3_distance")) | ends(".d3_status"), "analysis_metadata")
        .when(kind.isin("numeric", "mixed_numeric"), "numeric_feature")
        .when(kind.isin("boolean", "categorical"), "categorical_feature")
        .otherwise("unsupported")
    )


def profiles(counts: DataFrame, missing_share: float = 0.40, near_constant: float = 0.95) -> DataFrame:
    """A row per column of cell counts: missing by class, type, mode, flags, category, status and eligibility."""
    is_in = lambda s: F.col("state") == s
    total = lambda c, what="n": F.coalesce(F.sum(F.when(c, F.col(what))), F.lit(0))
    value = F.struct(F.coalesce("number", F.lit(float("-inf"))).alias("number"), F.col("text"))
    held = ~is_in("missing")
    odd = impossible(F.col("column_name"), F.col("number")).isNotNull()
    rows = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), total(held).alias("present"), total(is_in("missing")).alias("missing"), *(total(is_in("missing"), f"n_{c}").alias(f"missing_{c}") for c in CLASSES),
        F.count_if(held).alias("distinct_values"), total(is_in("numeric")).alias("numeric"), total(is_in("invalid")).alias("not_numbers"), total(odd).alias("impossible"),
        F.bool_and(F.when(held, F.lower("text").isin("true", "false"))).alias("flags_only"),
        F.min_by(F.struct("number", "text", "n"), F.when(held, F.struct((-F.col("n")).alias("n"), value.alias("v")))).alias("mode"),
    )
    present = F.col("present")
    kind = (
        F.when(present == 0, "empty").when(F.coalesce("flags_only", F.lit(False)), "boolean").when(F.col("numeric") == present, "numeric")
        .when((F.col("numeric") > 0) & (F.col("not_numbers") > 0), "mixed_numeric").otherwise("categorical")
    )
    rows = rows.withColumn("detected_type", kind)
    rows = rows.withColumn("category", category(F.col("column_name"), F.col("detected_type"))).withColumn("dominant", F.when(present > 0, F.col("mode.n")))
    rows = rows.withColumn("dominant_share", F.col("dominant") / F.nullif(present, F.lit(0))).withColumn("missing_share", F.col("missing") / F.col("rows"))
    checked = F.col("detected_type").isin("numeric", "mixed_numeric")
    rows = rows.withColumn("invalid_numeric", F.when(checked, F.col("not_numbers") + F.col("impossible")).otherwise(0))
    constant = (F.col("distinct_values") == 1) & (present > 0)
    flags = F.array_compact(F.array(
        F.when(constant, "constant"), F.when(present == 0, "fully_empty"),
        F.when(checked & (F.col("impossible") > 0) | (F.col("category") == "numeric_feature") & (F.col("not_numbers") > 0), "invalid_numeric"),
        F.when(F.col("missing_share") > missing_share, "missing_heavy"), F.when(~constant & (F.col("dominant_share") >= near_constant), "near_constant"),
    ))
    return with_status(rows.withColumn("flags", flags)).select(
        "column_name", "category", "detected_type", "rows", "present", "missing", "missing_share", *(f"missing_{c}" for c in CLASSES), "distinct_values", "invalid_numeric",
        F.when(present > 0, F.col("mode.number")).alias("mode_number"), F.when(present > 0, F.col("mode.text")).alias("mode_text"), "dominant", "dominant_share", "flags", "status", "eligible", "reason",
    )


def with_status(rows: DataFrame) -> DataFrame:
    """status, eligible and reason of a profile row: target, then its category, then its flags in order of weight."""
    c, has = F.col("category"), lambda f: F.array_contains("flags", f)
    by_category = c.isin("identifier", "path", "timestamp", "source_metadata", "analysis_metadata", "possible_leakage", "unsupported", "fully_empty")
    weights = ("fully_empty", "invalid_numeric", "constant", "near_constant", "missing_heavy")
    flag = F.coalesce(*(F.when(has(w), F.lit(w)) for w in weights))
    status = (
        F.when(c == "target", "target").when(c.isin("source_metadata", "analysis_metadata"), "metadata_only").when(by_category, c)
        .otherwise(F.coalesce(flag, F.when(c == "numeric_feature", "candidate").otherwise("review_required")))
    )
    reason = F.when(c == "target", "target column").when(by_category, F.concat(F.lit("category "), c)).otherwise(F.coalesce(flag, F.lit("no encoding")))
    return rows.withColumn("status", status).withColumn("eligible", F.col("status") == "candidate").withColumn("reason", F.when(~F.col("eligible"), reason))


def leakage_findings(counts: DataFrame, target: str) -> DataFrame:
    """Of cell counts: every column but the target whose name or values can expose the label, with the greatest severity and the terms held; the gravest first."""
    low, has = F.lower("column_name"), lambda *words: reduce(Column.__or__, (F.contains(F.lower("column_name"), F.lit(w)) for w in words))
    named = F.when(has("label"), "critical").when((low == "sample_id") | has("video_name", "file", "path"), "high").when(low.isin("source", "notes") | has("generator"), "medium")
    text = F.lower("text")
    held = [F.bool_or(F.contains(text, F.lit(t))).alias(f"t{i}") for i, t in enumerate(sorted(SOURCE_TERMS))]
    terms = F.array_compact(F.array(*(F.when(F.col(f"t{i}"), t) for i, t in enumerate(sorted(SOURCE_TERMS)))))
    found = counts.filter(F.col("column_name") != target).groupBy("column_name").agg(*held).select("column_name", named.alias("name_severity"), terms.alias("terms"))
    severity = F.coalesce("name_severity", F.when(F.size("terms") > 0, "medium"))
    out = found.select("column_name", severity.alias("severity"), F.array_join("terms", "|").alias("terms")).filter("severity is not null")
    return out.orderBy(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2), "column_name")


def with_leakage(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Profiles with the category of columns that can expose the label set to possible_leakage; `findings` has a row per such column."""
    found = findings.select("column_name", F.lit(True).alias("_leak"))
    leak = F.coalesce("_leak", F.lit(False)) & (F.col("category") != "target")
    both = rows.join(F.broadcast(found), "column_name", "left").withColumn("category", F.when(leak, "possible_leakage").otherwise(F.col("category")))
    both = both.withColumn("flags", F.when(leak, F.array_sort(F.array_append("flags", F.lit("possible_leakage")))).otherwise(F.col("flags"))).drop("_leak")
    return with_status(both).select(*rows.columns)


def full_audit(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Profiles of the columns after the scan for leakage."""
    counts = cell_counts(df, columns, target)
    return with_leakage(profiles(counts), leakage_findings(counts, target))


def missing_table(rows: DataFrame) -> DataFrame:
    """Columns with missing values, by class, and how that may be read."""
    reading = F.when(F.startswith("column_name", F.lit("audio_summary.")), "absence and failure cannot be told apart").when(F.col("present") == 0, "fully empty").otherwise("review")
    by_class = [F.col(f"missing_{c}") for c in CLASSES]
    return rows.filter("missing > 0").select("column_name", "missing", "missing_share", "present", (F.col("present") == 0).alias("fully_empty"), *by_class, (by_class[0] != by_class[1]).alias("differs_by_class"), reading.alias("interpretation"))


def constant_table(rows: DataFrame) -> DataFrame:
    has = lambda f: F.array_contains("flags", f)
    return rows.filter(has("constant") | has("near_constant") | has("fully_empty")).select("column_name", "distinct_values", "dominant", "dominant_share", has("constant").alias("constant"), has("near_constant").alias("near_constant"))


def invalid_cells(df: DataFrame, columns: Sequence[str], target: str, key: str, most: int = 10) -> DataFrame:
    """Up to `most` invalid or impossible cells of each column, in order of key: a report of examples; the counts are in the profiles."""
    held = cells(df.withColumn("_key", F.col(f"`{key}`")), columns, "_key").withColumnRenamed("label", "key")
    why = F.when(F.col("state") == "invalid", F.when(F.col("text").isNull() | F.lower(F.btrim("text")).rlike(r"^[+-]?(inf|infinity)$"), "not finite").otherwise("mixed text")).otherwise(impossible(F.col("column_name"), F.col("number")))
    bad = held.withColumn("reason", why).filter("reason is not null")
    n = F.row_number().over(Window.partitionBy("column_name").orderBy("key", "reason"))
    return bad.withColumn("_n", n).filter(F.col("_n") <= most).select("column_name", "key", "number", "text", "reason")


def model_schema(rows: DataFrame, forbidden: Sequence[str] = ("label", "path", "file", "video_name", "sample_id", "sha256", "hash")) -> DataFrame:
    """Included and excluded columns with the reason; an included name that holds a forbidden word is an error of its own row."""
    bad = reduce(Column.__or__, (F.contains(F.lower("column_name"), F.lit(w)) for w in forbidden))
    kept = F.col("eligible")
    return rows.filter("category <> 'target'").select("column_name", F.when(kept & bad, "forbidden").when(kept, "included").otherwise("excluded").alias("role"), F.col("reason").alias("exclusion_reason"), "category", "detected_type", "missing", "missing_share", "status", F.array_join("flags", "|").alias("flags"))


def readiness(df: DataFrame, rows: DataFrame, target: str, identity: Sequence[str], least: int = 100, per_class: int = 50, enough: int = 500) -> DataFrame:
    """One row: sizes, what speaks against an experiment, and the decision. `identity` are columns whose values may not repeat, `*` the row."""
    from reelgrain.operators.audit import duplicate_counts

    sizes = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{target}`") == c).alias(c) for c in CLASSES))
    repeated = duplicate_counts(df, [c for c in identity if c != "*"]).filter(F.col("key").isin(*identity)).agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("duplicates"))
    found = rows.agg(F.coalesce(F.sum("invalid_numeric"), F.lit(0)).alias("invalid_numeric"), F.count_if("eligible").alias("candidates"))
    all_in_one = sizes.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(found))  # one row each
    low = F.least(*CLASSES)
    small = (F.col("rows") < least) | (low < per_class)
    unclean = (low == 0) | (F.col("duplicates") > 0) | (F.col("invalid_numeric") > 0) | (F.col("candidates") == 0)
    decision = F.when(small, "insufficient_dataset_size").when(unclean, "requires_cleanup").when(F.col("rows") < enough, "audit_passed_for_experimentation").otherwise("ready_for_baseline_experiment")
    return all_in_one.select("rows", *CLASSES, "duplicates", "invalid_numeric", "candidates", decision.alias("decision"))
