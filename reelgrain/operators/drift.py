"""Flat JSON records whose fields drift from file to file: one consistent table and an ordered list of changes.

Each task folds the records it reads into one bit set per (file, field name): a lattice whose join is bitwise or, so
that partial results merge in any order. Types promote boolean < integer < float < string. Only these folded headers
are shuffled to find changes; the records themselves are cast once, in the order of the newest schema.

Defined results. A payload that is null or no JSON object holds no fields (its file is a file all the same). Repeated
deliveries change nothing. A file's version is its records' greatest, compared number by number; without one nothing is
deprecated in it. A producer's first file has no added, removed, renamed or retyped features. An object or array as a
value counts as a string. NaN and Infinity count as floats.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.session import small_rows

PRESENT, BOOLEAN, INTEGER, FLOAT, STRING = 1, 2, 4, 8, 16
NOT_FEATURES = ("sample_id", "identity.feature_schema_version")
VERSION = "identity.feature_schema_version"
_BIT = {bool: BOOLEAN, int: INTEGER, float: FLOAT, type(None): 0}


def version_key(version: str | None) -> tuple[int, ...]:
    """Numbers of a version; a leading v does not count."""
    return tuple(int(x) for x in re.findall(r"\d+", version.strip().lstrip("vV"))) if version else ()


def _parts(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def current_names(evolution: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """name -> the last id it reached, and id -> deprecated version. The registry is metadata of bounded size."""
    rows = small_rows(evolution.select("id", "aliases", "renamed_from", "deprecated_version"))
    step = {r.renamed_from: r.id for r in rows if r.renamed_from}
    names: dict[str, str] = {}
    for r in rows:
        last, seen = r.id, {r.id}
        while last in step and step[last] not in seen:
            last = step[last]
            seen.add(last)
        names[r.id] = last
    for r in rows:
        for alias in r.aliases or []:
            names.setdefault(alias, names[r.id])
    for old in step:
        names.setdefault(old, names[step[old]])
    return names, {r.id: r.deprecated_version for r in rows if r.deprecated_version}


def _record(payload: str | None) -> dict | None:
    try:
        found = json.loads(payload) if payload is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: (producer, file, name) -> joined type bits; the version is carried as a name of its own."""
    for batch in batches:
        bits: dict[tuple, int] = {}
        producers, files, payloads = (batch.column(i).to_pylist() for i in range(3))
        for producer, file_no, payload in zip(producers, files, payloads):
            bits.setdefault((producer, file_no, None, None), 0)
            for name, value in (_record(payload) or {}).items():
                if name == VERSION:
                    bits[producer, file_no, None, str(value) if value is not None else None] = 0
                elif name not in NOT_FEATURES:
                    at = (producer, file_no, name, None)
                    bits[at] = bits.get(at, 0) | PRESENT | _BIT.get(type(value), STRING)
        columns = list(zip(*bits)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(list(bits.values()), pa.int32())], names=["producer", "file_no", "name", "version", "bits"])


def file_headers(records: DataFrame) -> DataFrame:
    """producer, file_no, name, bits: a row per field of a file, and one with a null name that bears its version."""
    folded = records.select("producer", F.col("file_no").cast("int").alias("file_no"), "payload").mapInArrow(_fold, "producer string, file_no int, name string, version string, bits int")
    ordered = F.struct(_parts(F.col("version")).alias("parts"), F.col("version"))
    return folded.groupBy("producer", "file_no", "name").agg(F.bit_or("bits").alias("bits"), F.max(F.when(F.col("version").isNotNull(), ordered)).alias("v")).select("producer", "file_no", "name", "bits", F.col("v.version").alias("version"))


def data_type(bits: Column) -> Column:
    has = lambda b: bits.bitwiseAND(b) > 0
    return F.when(has(STRING), "string").when(has(FLOAT), "float").when(has(INTEGER), "integer").when(has(BOOLEAN), "boolean")


def file_features(headers: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """producer, file_no, feature_id, data_type, names: a row per feature of a file."""
    lookup = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    fields = headers.filter("name is not null").withColumn("feature_id", F.coalesce(F.try_element_at(lookup, F.col("name")), F.col("name")))
    return fields.groupBy("producer", "file_no", "feature_id").agg(data_type(F.bit_or("bits")).alias("data_type"), F.array_sort(F.collect_set("name")).alias("names"))


def changes(records: DataFrame, evolution: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """producer, file_no, feature_id, change."""
    names, deprecated = current_names(evolution)
    headers = file_headers(records) if headers is None else headers
    series = Window.partitionBy("producer").orderBy("file_no")
    files = headers.filter("name is null").select("producer", "file_no", "version").withColumns({"k": F.row_number().over(series), "next_file": F.lead("file_no").over(series)})
    features = file_features(headers, names).join(files, ["producer", "file_no"])
    by = Window.partitionBy("producer", "feature_id").orderBy("k")
    before = F.lag(F.struct("k", "data_type", "names")).over(by)
    features = features.withColumns({"b": before, "next_k": F.lead("k").over(by)})
    adjacent = F.coalesce(F.col("b.k") == F.col("k") - 1, F.lit(False))
    lookup = F.create_map(*(F.lit(x) for pair in deprecated.items() for x in pair)) if deprecated else F.create_map().cast("map<string,string>")
    since = F.try_element_at(lookup, F.col("feature_id"))
    own = features.select(
        "producer", "file_no", "feature_id", "next_file", "next_k", "k",
        F.array_compact(F.array(
            F.when((F.col("k") > 1) & ~adjacent, "added"),
            F.when(adjacent & (F.col("b.names") != F.col("names")), "renamed"),
            F.when(adjacent & (F.col("b.data_type") != F.col("data_type")), "retyped"),
            F.when(since.isNotNull() & F.col("version").isNotNull() & (_parts(since) <= _parts(F.col("version"))), "deprecated"),
            F.when(F.col("next_file").isNotNull() & ~F.coalesce(F.col("next_k") == F.col("k") + 1, F.lit(False)), "removed"),
        )).alias("found"),
    )
    own = own.select("producer", "file_no", "next_file", "feature_id", F.explode("found").alias("change"))
    return own.select("producer", F.when(F.col("change") == "removed", F.col("next_file")).otherwise(F.col("file_no")).alias("file_no"), "feature_id", "change")


_SPARK = {"integer": "bigint", "float": "double", "boolean": "boolean", "string": "string"}


def newest_schema(schema: DataFrame) -> list[tuple[str, str]]:
    rows = small_rows(schema.select("feature_schema_version", "export_name", "data_type"))
    newest = max((r[0] for r in rows), key=version_key, default=None)
    return sorted((r[1], r[2]) for r in rows if r[0] == newest)


def unified(records: DataFrame, evolution: DataFrame, schema: DataFrame) -> DataFrame:
    """One row per record_id, under the names and types of the newest schema.

    Values are read as text under every name that leads to a column (the newest name first) and cast. `not_cast` names the
    columns whose value does not fit their type: text that is no number, a fraction under an integer, an integer beyond 64
    bits, a flag that is neither true nor false; their value is null. Equal deliveries of a record count once.
    """
    names, _ = current_names(evolution)
    fields = F.from_json("payload", "map<string,string>")
    out, failed = [], []
    for column, kind in newest_schema(schema):
        known = [column, *sorted(n for n, last in names.items() if last == column and n != column)]
        text = F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in known))
        number = text.try_cast("double")
        whole = F.coalesce(text.try_cast("bigint"), F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.cast("bigint")))
        value = whole if kind == "integer" else text.try_cast(_SPARK.get(kind, "string"))
        out.append(value.alias(column))
        failed.append(F.when(text.isNotNull() & value.isNull(), column))
    rows = records.select("record_id", "producer", F.col("file_no").cast("int").alias("file_no"), fields.alias("fields"))
    sample = F.try_element_at("fields", F.lit("sample_id")).alias("sample_id")
    missed = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return rows.select("record_id", "producer", "file_no", sample, *out, missed.alias("not_cast")).dropDuplicates(["record_id"])


def uncast(whole: DataFrame) -> DataFrame:
    """producer, file_no, column_name, n: how many values of a file did not fit the newest type of their column."""
    return whole.select("producer", "file_no", F.explode("not_cast").alias("column_name")).groupBy("producer", "file_no", "column_name").agg(F.count(F.lit(1)).alias("n"))
