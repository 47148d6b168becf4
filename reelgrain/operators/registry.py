"""Feature registries: checks, typed cells, findings by cell, declared transforms, schema documents and their comparison.

A registry is metadata of at most some thousand features and lives in the driver as mappings; whatever concerns rows is a
Spark expression built from it.

Defined results: an empty table gives no findings about cells; null, NaN and the missing words are missing; a value that
does not fit its type is `invalid_type`, also an infinity; columns that are not registered are left alone by cell checks.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.text import present_lower
from reelgrain.operators.validation import fingerprint, safe_ratio, strict_sum, topological

TYPES = ("integer", "float", "boolean", "string", "categorical")
BARRED = ("identifier", "target", "path", "timestamp", "source_metadata", "analysis_metadata", "leakage", "unsupported", "deprecated")
CATEGORIES = ("raw_numeric", "raw_boolean", "raw_categorical", "derived_numeric", *BARRED)
TRANSFORMS = ("safe_ratio", "sum", "availability_count", "availability_indicator")
#: Exported names that give the label or the sample away.
EXPOSING = ("expected_label", "identity.expected_label", "identity.video_name", "identity.analysis_id", "feature_file", "sample_id", "source", "generator_or_camera", "notes")
VERSION = re.compile(r"\d+\.\d+\.\d+")


@dataclass(frozen=True)
class Feature:
    """One registered feature."""

    id: str
    export_name: str
    category: str
    data_type: str
    introduced_version: str
    display_name: str = ""
    description: str = ""
    source_module: str = ""
    units: str | None = None
    nullable: bool = True
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    allowed_values: tuple | None = None
    model_candidate: bool = False
    leakage_risk: bool = False
    deprecated_version: str | None = None
    derived: bool = False
    dependencies: tuple[str, ...] = ()
    transformation: Mapping[str, Any] | None = None
    aliases: tuple[str, ...] = ()
    notes: str = ""


FIELDS = tuple(Feature.__dataclass_fields__)


def load_registry(source: str | Path) -> list[dict]:
    """The features of a registry file or text; what is not an object with a list of objects is an error."""
    text = Path(source).read_text(encoding="utf-8-sig") if isinstance(source, Path) or not str(source).lstrip().startswith(("{", "[")) else str(source)
    try:
        document = json.loads(text)
    except json.JSONDecodeError as x:
        raise ValueError(f"the registry is not JSON: {x}") from x
    features = document.get("features") if isinstance(document, dict) else None
    if not isinstance(features, list) or not all(isinstance(f, dict) for f in features):
        raise ValueError("a registry is an object with a list of features")
    return features


def typed(raw: Iterable[Mapping]) -> list[Feature]:
    """Features of checked registry entries."""
    lists = ("allowed_values", "dependencies", "aliases")
    return [Feature(**{k: tuple(v) if k in lists and v is not None else () if k in lists[1:] and v is None else v for k, v in f.items() if k in FIELDS}) for f in raw]


def registry_findings(raw: Sequence[Mapping]) -> list[tuple[str, str, str]]:
    """(severity, feature, rule) of everything wrong in a registry."""
    out: list[tuple[str, str, str]] = []
    twice = lambda values, rule: out.extend(("error", v, rule) for v, n in sorted(Counter(x for x in values if x).items()) if n > 1)
    twice([f.get("id") for f in raw], "repeated id")
    twice([f.get("export_name") for f in raw], "repeated export name")
    whole = [f for f in raw if not set(FIELDS) - set(f)]
    out += [("error", str(f.get("id")), f"lacks {name}") for f in raw for name in FIELDS if name not in f]
    twice([a for f in whole for a in f["aliases"] or ()], "repeated alias")
    known = {f.get("id") for f in raw}
    for f in whole:
        low, high, of = f["minimum"], f["maximum"], f["transformation"]
        barred = f["category"] in BARRED or f["leakage_risk"]
        rules = {
            "unknown category": f["category"] not in CATEGORIES,
            "unknown type": f["data_type"] not in TYPES,
            "introduced version is none": not VERSION.fullmatch(f["introduced_version"] or ""),
            "deprecated version is none": f["deprecated_version"] is not None and not VERSION.fullmatch(f["deprecated_version"]),
            "minimum above maximum": low is not None and high is not None and low > high,
            "derived without dependencies": f["derived"] and not f["dependencies"],
            "derived without transform": f["derived"] and not of,
            "unknown transform": bool(of) and of.get("type") not in TRANSFORMS,
            "barred as candidate": f["model_candidate"] and barred,
            "exposing name as candidate": f["model_candidate"] and f["export_name"] in EXPOSING,
            "derived from the target": f["derived"] and "expected_label" in (f["dependencies"] or ()),
            "deprecated as candidate": bool(f["deprecated_version"]) and f["model_candidate"],
        }
        out += [("error", f["id"], rule) for rule, broken in rules.items() if broken]
        out += [("error", f["id"], f"unknown dependency {d}") for d in f["dependencies"] or () if d not in known]
        if f["category"] == "deprecated" and not f["deprecated_version"]:
            out.append(("warning", f["id"], "deprecated without version"))
    try:
        topological({f["id"]: f["dependencies"] or () for f in whole})
    except ValueError as x:
        out.append(("error", "", str(x)))
    return out


def coerced(c: Column, source: str, kind: str) -> Column:
    """A value of Spark type `source` as a registered type; null where it is missing or does not fit."""
    text = F.btrim(c.cast("string"))
    number = F.expr("cast(null as double)")
    if source in ("string",):
        number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    elif source != "boolean":
        number = c.cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if kind == "float":
        return number
    if kind == "integer":
        return F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.cast("bigint"))
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    return F.when(present_lower(text).isNotNull(), c.cast("string"))


def value_findings(df: DataFrame, key: str, features: Sequence[Feature]) -> DataFrame:
    """key, column_name, finding of every registered cell that breaks its entry: invalid_null, invalid_type or out_of_range; the first that applies."""
    types, parts = dict(df.dtypes), []
    for f in (f for f in features if f.export_name in types):
        x = F.col(f"`{f.export_name}`")
        missing = x.isNull() | F.isnan(x) if types[f.export_name] in ("double", "float") else present_lower(x.cast("string")).isNull()
        value = coerced(x, types[f.export_name], f.data_type)
        outside = F.lit(False)
        if f.data_type in ("integer", "float"):
            outside = F.coalesce(value < F.lit(f.minimum), F.lit(False)) | F.coalesce(value > F.lit(f.maximum), F.lit(False))
        allowed = value.cast("string").isin(*(str(v).lower() if isinstance(v, bool) else str(v) for v in f.allowed_values)) if f.allowed_values is not None else F.lit(True)
        bad_null = missing & F.lit(f.required or not f.nullable)
        finding = F.when(bad_null, "invalid_null").when(~missing & (value.isNull() | ~allowed), "invalid_type").when(~missing & outside, "out_of_range")
        parts.append(F.when(finding.isNotNull(), F.struct(F.lit(f.export_name).alias("column_name"), finding.alias("finding"))))
    if not parts:
        return df.select(key, F.lit("").alias("column_name"), F.lit("").alias("finding")).limit(0)
    return df.select(F.col(key), F.inline(F.array_compact(F.array(*parts))))


def column_findings(columns: Sequence[str], features: Sequence[Feature], strict: bool = False, allow_unregistered: bool = False) -> list[tuple[str, str, str]]:
    """(severity, column, finding) by name: unregistered, missing_required, deprecated."""
    known = {f.export_name: f for f in features}
    out = [("error" if strict else "warning", c, "unregistered") for c in sorted(columns) if c not in known and not allow_unregistered]
    out += [("error", f.export_name, "missing_required") for f in features if f.required and f.export_name not in columns]
    return out + [("warning", c, "deprecated") for c in sorted(columns) if c in known and known[c].deprecated_version]


def number(c: Column, source: str) -> Column:
    return coerced(c, source, "float")


def derived(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """The declared features as columns, each after what it depends on, and `missing_dependencies`, how many inputs were null.

    safe_ratio is null for a missing side or a zero denominator, sum for any missing part; availability_indicator is 0 where
    its input is missing, false or 0, else 1; availability_count is the share of its inputs above 0, where an input named in
    `completed` counts with the value `completed`.
    """
    by_id = {f.id: f for f in features}
    order = [by_id[i] for i in topological({f.id: f.dependencies for f in features}) if by_id[i].derived]
    types, missing = dict(df.dtypes), F.lit(0)
    for f in order:
        names = [by_id[d].export_name for d in f.dependencies]
        absent = lambda n: F.col(f"`{n}`").isNull() if types[n] not in ("double", "float") else F.col(f"`{n}`").isNull() | F.isnan(F.col(f"`{n}`"))
        numbers = [number(F.col(f"`{n}`"), types[n]) for n in names]
        kind, how = f.transformation["type"], f.transformation
        if kind == "safe_ratio":
            value = safe_ratio(*numbers)
        elif kind == "sum":
            value = strict_sum(*numbers)
        elif kind == "availability_indicator":
            value = F.when(absent(names[0]) | F.lower(F.col(f"`{names[0]}`").cast("string")).isin("false", "0"), F.lit(0.0)).otherwise(F.lit(1.0))
        else:
            there = [F.col(f"`{n}`") == "completed" if n in how.get("completed", ()) else x > 0 for n, x in zip(names, numbers)]
            value = strict_sum(*(F.coalesce(t, F.lit(False)).cast("int") for t in there)) / F.lit(float(len(names)))
        missing = missing + strict_sum(*(absent(n).cast("int") for n in names))
        df = df.withColumn(f.export_name, value)
        types[f.export_name] = "double"
    return df.withColumn("missing_dependencies", missing)


def exclusion(f: Feature) -> str | None:
    """Why a feature is in no model schema."""
    if f.model_candidate:
        return None
    if f.deprecated_version:
        return "deprecated"
    if f.leakage_risk:
        return "leakage risk"
    return f"category is {f.category}" if f.category in BARRED else "not a model candidate"


def schema_document(features: Sequence[Feature], version: str) -> dict:
    """The model schema of a registry: raw candidates, then derived ones, their order, what is left out and why, and a fingerprint."""
    view = lambda f: {k: getattr(f, k) for k in ("id", "export_name", "data_type", "units", "nullable", "minimum", "maximum", "source_module", "dependencies", "derived", "model_candidate", "introduced_version", "deprecated_version")}
    raw, made = ([f for f in features if f.model_candidate and f.derived == d] for d in (False, True))
    document = {
        "feature_schema_version": version,
        "target": {"column": "expected_label", "encoding": {"real": 0, "ai_generated": 1}},
        "raw": [view(f) for f in raw],
        "derived": [view(f) for f in made],
        "feature_order": [f.export_name for f in (*raw, *made)],
        "excluded": [{"id": f.id, "export_name": f.export_name, "category": f.category, "reason": exclusion(f)} for f in features if not f.model_candidate],
        "deprecated": [view(f) for f in features if f.deprecated_version],
    }
    return document | {"schema_fingerprint": fingerprint(document)}


def compatibility(old: Mapping, new: Mapping) -> tuple[str, list[tuple[str, str]]]:
    """The status of a change of schema documents, and (severity, finding) of each difference."""
    found: list[tuple[str, str]] = []
    before, after = old["feature_order"], new["feature_order"]
    if before != after:
        found.append(("potentially_breaking", "feature order"))
    found += [("breaking", f"removed {n}") for n in sorted(set(before) - set(after))] + [("potentially_breaking", f"added {n}") for n in sorted(set(after) - set(before))]
    features = [{f["export_name"]: f for f in (*d["raw"], *d["derived"])} for d in (old, new)]
    for name in sorted(set(features[0]) & set(features[1])):
        found += [("breaking", f"{name}: {k}") for k in ("data_type", "units", "nullable", "minimum", "maximum", "dependencies") if features[0][name][k] != features[1][name][k]]
    severities = {s for s, _ in found}
    return "incompatible" if "breaking" in severities else "requires_regeneration" if "potentially_breaking" in severities else "compatible", found


def lineage(features: Sequence[Feature]) -> list[dict]:
    """Where each derived feature comes from."""
    by_id = {f.id: f for f in features}
    return [
        {"id": f.id, "export_name": f.export_name, "dependencies": list(f.dependencies), "source_modules": sorted({by_id[d].source_module for d in f.dependencies}), "formula": dict(f.transformation or {}), "introduced_version": f.introduced_version, "uses_target": False, "fitted": False}
        for f in features if f.derived
    ]


def evolution(features: Sequence[Feature], renamed: Mapping[str, str] | None = None) -> list[dict]:
    """What became of each feature, by version."""
    return [{"id": f.id, "introduced_version": f.introduced_version, "aliases": list(f.aliases), "renamed_from": (renamed or {}).get(f.id), "deprecated_version": f.deprecated_version} for f in features]


def standardised(df: DataFrame, features: Sequence[Feature], document: Mapping, key: str, label: str) -> DataFrame:
    """sample, schema and features structs: features in the schema's order, in their registered types; what is missing or does not fit is null."""
    by_name, types = {f.export_name: f for f in features}, dict(df.dtypes)
    spark_type = {"integer": "bigint", "float": "double", "boolean": "boolean"}
    cell = lambda n: (coerced(F.col(f"`{n}`"), types[n], by_name[n].data_type) if n in types else F.lit(None).cast(spark_type.get(by_name[n].data_type, "string"))).alias(n)
    return df.select(
        F.struct(F.col(f"`{key}`").cast("string").alias("sample_id"), F.col(f"`{label}`").alias("label")).alias("sample"),
        F.struct(F.lit(document["feature_schema_version"]).alias("feature_schema_version"), F.lit(document["schema_fingerprint"]).alias("schema_fingerprint")).alias("schema"),
        F.struct(*(cell(n) for n in document["feature_order"])).alias("features"),
    )


def preparation_profile(df: DataFrame, features: Sequence[Feature], key: str, version: str) -> DataFrame:
    """One row: sizes of table, registry and schema and the numbers of findings."""
    document, columns = schema_document(features, version), column_findings(df.columns, features)
    found = value_findings(df, key, features).agg(F.count_if(F.col("finding") == "invalid_type").alias("invalid_type_count"), F.count_if(F.col("finding") == "out_of_range").alias("out_of_range_count"), F.count_if(F.col("finding") == "invalid_null").alias("invalid_null_count"))
    inputs = derived(df, features).agg(F.count(F.lit(1)).alias("sample_count"), F.coalesce(F.sum("missing_dependencies"), F.lit(0)).cast("bigint").alias("missing_dependency_count"))
    facts = {
        "field_count": len(df.columns), "registered_feature_count": len(features), "unregistered_field_count": sum(c[2] == "unregistered" for c in columns), "raw_candidate_count": len(document["raw"]),
        "derived_feature_count": sum(f.derived for f in features), "standardised_feature_count": len(document["feature_order"]), "excluded_field_count": len(document["excluded"]),
    }
    return found.crossJoin(F.broadcast(inputs)).select("*", *(F.lit(v).alias(k) for k, v in facts.items()))  # one row each


def from_schema_table(rows: Sequence[Mapping], version: str) -> list[Feature]:
    """A registry of raw features from rows of a schema table (export_name, data_type, units, minimum, maximum)."""
    return [Feature(id=r["export_name"], export_name=r["export_name"], category="raw_numeric", data_type=r["data_type"], introduced_version=version, source_module=r["export_name"].partition(".")[0], units=r["units"], minimum=r["minimum"], maximum=r["maximum"], model_candidate=r["data_type"] in ("integer", "float")) for r in sorted(rows, key=lambda r: r["export_name"])]


#: The derived features of the dataset toolkit, as registry entries over the flat record.
DERIVED = (
    ("derived.exposure_extreme_ratio", "sum", ("frame_summary.dark_frame_ratio", "frame_summary.white_frame_ratio")),
    ("derived.sharpness_contrast_ratio", "safe_ratio", ("frame_summary.mean_sharpness", "frame_summary.mean_contrast")),
    ("derived.motion_spike_ratio", "safe_ratio", ("temporal_summary.maximum_motion_magnitude", "temporal_summary.mean_motion_magnitude")),
    ("derived.flow_residual_ratio", "safe_ratio", ("temporal_summary.maximum_flow_warp_residual", "temporal_summary.mean_flow_warp_residual")),
    ("derived.audio_features_available", "availability_indicator", ("audio_summary.audio_window_count",)),
    ("derived.evidence_module_coverage", "availability_count", ("frame_summary.sampled_frame_count", "temporal_summary.analyzed_transition_count", "audio_summary.audio_window_count", "visual_consistency_summary.analyzed_region_record_count", "d3_summary.d3_status")),
)


def derived_registry(version: str = "0.9.4") -> list[Feature]:
    """Raw inputs and the derived features."""
    inputs = sorted({d for _, _, parts in DERIVED for d in parts})
    raw = [Feature(id=n, export_name=n, category="raw_numeric", data_type="string" if n.endswith("_status") else "integer" if n.endswith("_count") else "float", introduced_version=version, source_module=n.partition(".")[0], model_candidate=not n.endswith("_status")) for n in inputs]
    made = [Feature(id=n, export_name=n, category="derived_numeric", data_type="float", introduced_version=version, source_module="derived", model_candidate=True, derived=True, dependencies=parts, transformation={"type": kind, "completed": ("d3_summary.d3_status",)}) for n, kind, parts in DERIVED]
    return raw + made
