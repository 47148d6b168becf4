"""Constraints as data: rule columns to violation rows, registries, schemas, derived features, plans and references."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FORBIDDEN = ("probability", "threshold", "confidence", "verdict")


def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks; a rule is a condition that is true where it is broken."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


def forbidden_fields(schema: T.StructType, banned: Sequence[str] = FORBIDDEN) -> list[str]:
    """Dotted paths of fields with a banned name at any depth."""

    def walk(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind for p in ([f"{path}{f.name}"] if f.name.lower() in banned else []) + walk(f.dataType, f"{path}{f.name}.")]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, path)
        return walk(kind.valueType, path) if isinstance(kind, T.MapType) else []

    return walk(schema, "")


def absolute_path(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z]:[\\/]|\A[/\\]")


def unsafe_path(c: Column) -> Column:
    return absolute_path(c) | F.array_contains(F.split(c, r"[/\\]"), "..")


def range_violations(df: DataFrame, key: str, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """key, column, value of every value out of its registered bounds."""
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value"), F.lit(bounds[c][0]).cast("double").alias("low"), F.lit(bounds[c][1]).cast("double").alias("high"))
    return df.select(key, F.inline(F.array(*map(cell, bounds)))).filter("value < low or value > high").filter("not isnan(value)").select(key, "column_name", "value")


def reference_problems(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Rows of `left` whose `key` is not in `right`, or is there with other values of `same` (null on either side agrees)."""
    other = right.select(key, F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in same)).dropDuplicates([key])
    joined = left.join(other, key, "left")
    return violations(joined, [key], {"missing": F.col("_there").isNull(), **{f"{c}_differs": F.col(c) != F.col(f"_{c}") for c in same}})


def existing(batch: DataFrame, known: DataFrame, key: str, present: bool) -> DataFrame:
    """Rows whose key is (not) already known."""
    return batch.join(known.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi" if present else "left_anti")


def schema_differences(schema: DataFrame, old: str, new: str, fields: Sequence[str] = ("data_type", "units", "minimum", "maximum")) -> DataFrame:
    """export_name, change, severity between two versions of a schema table: removed features and changed fields are breaking, added ones potentially so."""
    side = lambda v, p: schema.filter(F.col("feature_schema_version") == v).select("export_name", F.lit(True).alias(f"{p}_there"), *(F.col(c).alias(f"{p}_{c}") for c in fields))
    both = side(old, "o").join(side(new, "n"), "export_name", "full_outer")
    there = F.col("o_there").isNotNull() & F.col("n_there").isNotNull()
    changed = [F.when(there & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit(f"{c} changed").alias("change"), F.lit("breaking").alias("severity"))) for c in fields]
    added = F.when(F.col("o_there").isNull(), F.struct(F.lit("added").alias("change"), F.lit("potentially_breaking").alias("severity")))
    removed = F.when(F.col("n_there").isNull(), F.struct(F.lit("removed").alias("change"), F.lit("breaking").alias("severity")))
    return both.select("export_name", F.inline(F.array_compact(F.array(added, removed, *changed))))


def schema_status(differences: DataFrame) -> DataFrame:
    """One row: how many differences there are of each severity, and whether data of the old version still serve."""
    counts = differences.agg(F.count_if(F.col("severity") == "breaking").alias("breaking"), F.count_if(F.col("severity") == "potentially_breaking").alias("potentially_breaking"), F.count(F.lit(1)).alias("differences"))
    status = F.when(F.col("breaking") > 0, "incompatible").when(F.col("potentially_breaking") > 0, "requires_regeneration").when(F.col("differences") > 0, "compatible_with_warnings").otherwise("compatible")
    return counts.withColumn("status", status)


def fingerprint(document: Mapping, volatile: Sequence[str] = ("generated_at", "schema_fingerprint")) -> str:
    """SHA-256 of a document's canonical JSON without its volatile keys."""
    text = json.dumps({k: v for k, v in document.items() if k not in volatile}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def row_fingerprint(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


# Declared transforms of derived features: a closed set, each an expression of columns.
def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def strict_sum(*columns: Column) -> Column:
    return reduce(Column.__add__, columns)


def available(c: Column) -> Column:
    return F.when(c.isNotNull(), 1).otherwise(0)


def available_share(*conditions: Column) -> Column:
    return strict_sum(*(F.coalesce(c, F.lit(False)).cast("int") for c in conditions)) / len(conditions)


def topological(features: Mapping[str, Sequence[str]]) -> list[str]:
    """Features after what they depend on, by name where free; a cycle is an error."""
    order, left = [], {k: {d for d in v if d in features} for k, v in features.items()}
    while left:
        free = sorted(k for k, v in left.items() if not v)
        if not free:
            raise ValueError(f"dependency cycle among {sorted(left)}")
        order += free
        left = {k: v - set(free) for k, v in left.items() if k not in free}
    return order


def label_of(sources: Sequence[Column], override: bool = False) -> Column:
    """The first label there is; null where two sources disagree, unless the first may override."""
    first = F.coalesce(*sources)
    conflict = reduce(Column.__or__, (F.coalesce(s != first, F.lit(False)) for s in sources))
    return first if override else F.when(~conflict, first)


def availability(records: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """found, missing, ambiguous or invalid for each record's file name, by the paths listed under it."""
    paths = listing.groupBy(F.lower(name).alias("_n")).agg(F.count_distinct("path").alias("paths"))
    joined = records.withColumn("_n", F.lower(name)).join(paths, "_n", "left")
    status = F.when(F.coalesce(F.btrim(F.col(name)), F.lit("")) == "", "invalid").when(F.col("paths").isNull(), "missing").when(F.col("paths") > 1, "ambiguous").otherwise("found")
    return joined.withColumn("status", status).drop("_n", "paths")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a key's rows are folded before the shuffle."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def numbered_repeats(df: DataFrame, key: str, order: str, mark: str = "-dup%02d") -> DataFrame:
    """`suffix`: empty for a key's first row, then -dup02, -dup03 and so on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("n", n).withColumn("suffix", F.when(F.col("n") > 1, F.format_string(mark, F.col("n"))).otherwise("")).drop("n")
