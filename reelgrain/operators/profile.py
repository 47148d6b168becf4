"""Column-level quality profile of a table that arrives in loads.

One pass makes mergeable aggregates for each (run, load): counts, missing counts, exact decimal sums of x and x^2 (from
which means, deviations and standardised differences between loads follow), ranges, and counts of values out of bounds
or against a pattern. A second, the grouped distinct values with their counts, gives distinct counts and the exact
largest difference of the distribution functions of two loads.

Defined results. Rows with one key count once. Null and NaN are missing. A load is compared with the run's next lower
load that is there; a run's first load has no changes. A side without non-missing values has no shift. Sums leave out
infinities and values beyond decimal(20,6); `summed` is how many they hold, and means are over these. Flags and texts have
counts and distinct values, and violations where they have a pattern. A load without a summary row has no missing_count
finding; a null map has no entries. An empty table gives an empty profile. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.session import small_rows, written

NUMERIC = (
    *(f"media.{c}" for c in ("duration_seconds", "width", "height", "frame_rate", "frame_count")),
    *(f"frame_summary.{c}" for c in ("sampled_frame_count", "mean_brightness", "mean_contrast", "mean_sharpness", "dark_frame_ratio", "white_frame_ratio")),
)
PATTERNS = {
    "identity.video_sha256": r"\A[0-9a-f]{64}\z",
    "identity.video_name": r"\A[^/\\]+\.(mp4|mov|mkv|avi|webm)\z",
}
NULL_RATE, SHIFT, BUCKETS = 0.12, 0.3, 1024


def schema_bounds(schema: DataFrame, version: str = "0.10.0") -> dict[str, tuple[float | None, float | None]]:
    """name -> (minimum, maximum) of one schema version; the registry is a metadata table of at most some hundred rows."""
    rows = small_rows(schema.filter(F.col("feature_schema_version") == version).select("export_name", "minimum", "maximum"))
    return {r[0]: (r[1], r[2]) for r in rows}


def _value(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


class LoadProfile:
    """The aggregates of a table by (run_id, load_no); each report is derived from them."""

    def __init__(self, df: DataFrame, numeric: Sequence[str] = NUMERIC, patterns: Mapping[str, str | None] = PATTERNS, bounds: Mapping[str, tuple[float | None, float | None]] | None = None, key: str = "record_id"):
        self.numeric, self.patterns, self.bounds = list(numeric), dict(patterns), dict(bounds or {})
        named = [_value(c).alias(f"v{i}") for i, c in enumerate(self.numeric)]
        texts = [F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(self.patterns)]
        self.rows = df.select(key, "run_id", "load_no", *named, *texts).dropDuplicates([key]).drop(key)

    def keep(self) -> LoadProfile:
        """Write the distinct rows once, so that each report reads them and none repeats the shuffle."""
        self.rows = written(self.rows, "profile")
        return self

    def _numeric_aggregates(self, i: int) -> list[Column]:
        v = F.col(f"v{i}")
        exact = F.expr(f"try_cast(v{i} as decimal(20,6))")
        low, high = self.bounds.get(self.numeric[i], (None, None))
        outside = (v < low if low is not None else F.lit(False)) | (v > high if high is not None else F.lit(False))
        return [
            F.count(v).alias("present"), F.count(exact).alias("summed"), F.try_sum(exact).alias("s1"), F.try_sum(exact * exact).alias("s2"),
            F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(outside).alias("violations"),
        ]

    def by_load(self) -> DataFrame:
        """One row per run, load and column."""
        aggregates, parts = [F.count(F.lit(1)).alias("n")], []
        for i, name in enumerate(self.numeric):
            own = self._numeric_aggregates(i)
            aggregates += [a.alias(f"n{i}_{k}") for k, a in zip(("present", "summed", "s1", "s2", "low", "high", "violations"), own)]
            parts.append(F.struct(F.lit(name).alias("column_name"), *(F.col(f"n{i}_{k}").cast(t).alias(k) for k, t in (("present", "bigint"), ("summed", "bigint"), ("s1", "decimal(38,6)"), ("s2", "decimal(38,6)"), ("low", "double"), ("high", "double"), ("violations", "bigint")))))
        for i, (name, pattern) in enumerate(self.patterns.items()):
            s = F.col(f"s{i}")
            aggregates += [F.count(s).alias(f"t{i}_present"), F.count_if(F.lit(False) if pattern is None else ~s.rlike(pattern)).alias(f"t{i}_bad")]
            null = lambda t: F.lit(None).cast(t)
            parts.append(F.struct(F.lit(name).alias("column_name"), F.col(f"t{i}_present").alias("present"), null("bigint").alias("summed"), null("decimal(38,6)").alias("s1"), null("decimal(38,6)").alias("s2"), null("double").alias("low"), null("double").alias("high"), F.col(f"t{i}_bad").alias("violations")))
        wide = self.rows.groupBy("run_id", "load_no").agg(*aggregates)
        return wide.select("run_id", "load_no", "n", F.inline(F.array(*parts))).withColumn("missing", F.col("n") - F.col("present"))

    def value_counts(self) -> DataFrame:
        """(run, load, column, value) with its count; partial aggregation runs before the shuffle."""
        pairs = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("value")) for i in range(len(self.numeric))))
        return self.rows.select("run_id", "load_no", F.inline(pairs)).filter("value is not null").groupBy("run_id", "load_no", "c", "value").agg(F.count(F.lit(1)).alias("k"))

    def distinct_counts(self) -> DataFrame:
        """run_id, load_no, column_name, distinct_values of every column."""
        counted = lambda kind, names: (
            self.rows.select("run_id", "load_no", F.inline(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"{kind}{i}").alias("value")) for i, n in enumerate(names)))))
            .filter("value is not null").distinct().groupBy("run_id", "load_no", "column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
        )
        parts = [counted(kind, names) for kind, names in (("v", self.numeric), ("s", list(self.patterns))) if names]
        return reduce(DataFrame.unionByName, parts)

    def changes(self, profile: DataFrame | None = None) -> DataFrame:
        """The profile with the load before, the change of the null rate and the standardised difference of means."""
        by_run = Window.partitionBy("run_id", "column_name").orderBy("load_no")
        mean = F.col("s1").cast("double") / F.nullif(F.col("summed"), F.lit(0))
        variance = F.greatest(F.lit(0.0), F.col("s2").cast("double") / F.nullif(F.col("summed"), F.lit(0)) - mean * mean)
        out = (self.by_load() if profile is None else profile).withColumns({"mean": mean, "variance": variance, "null_rate": F.col("missing") / F.col("n")})
        for c in ("load_no", "present", "null_rate", "mean", "variance", "low", "high"):
            out = out.withColumn(f"before_{c}", F.lag(c).over(by_run))
        pooled = F.sqrt((F.col("variance") + F.col("before_variance")) / 2)
        return out.withColumns({"null_rate_change": F.col("null_rate") - F.col("before_null_rate"), "standardised_difference": (F.col("mean") - F.col("before_mean")) / F.nullif(pooled, F.lit(0.0))})

    def shifts(self, changes: DataFrame, limit: float = SHIFT, buckets: int = BUCKETS) -> DataFrame:
        """(run, load, column) whose distribution functions differ from the load before's by more than `limit` somewhere.

        Counts are summed by bucket of the common range first (a window over at most `buckets` rows), so that exact
        running sums are taken within a bucket only, and only where a bucket's mass can reach the limit.
        """
        names = {name: i for i, name in enumerate(self.numeric)}
        number = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        pairs = changes.filter("before_load_no is not null and present > 0 and before_present > 0 and low is not null").select(
            "run_id", number[F.col("column_name")].alias("c"), F.col("load_no").alias("load"), F.col("before_load_no"),
            F.least("low", "before_low").alias("lo"), F.greatest("high", "before_high").alias("hi"), F.col("present").alias("na"), F.col("before_present").alias("nb"),
        )
        sides = pairs.select("*", F.inline(F.array(F.struct(F.col("load").alias("load_no"), F.lit(1).alias("new")), F.struct(F.col("before_load_no").alias("load_no"), F.lit(0).alias("new")))))
        place = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * buckets)
        weight = F.when(F.col("new") == 1, F.col("k") / F.col("na")).otherwise(-F.col("k") / F.col("nb"))
        points = (
            written(self.value_counts(), "values").join(sides, ["run_id", "load_no", "c"])
            .select("run_id", "load", "c", F.coalesce(F.nanvl(place.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("bucket"), "value", weight.alias("w"))
            .groupBy("run_id", "load", "c", "bucket", "value").agg(F.sum("w").alias("d"), F.sum(F.greatest("w", F.lit(0.0))).alias("up"), F.sum(F.least("w", F.lit(0.0))).alias("down"))
        )
        points = written(points, "points")
        group = ["run_id", "load", "c"]
        before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        eps = 1e-9
        mass = points.groupBy(*group, "bucket").agg(F.sum("d").alias("d"), F.sum("up").alias("up"), F.sum("down").alias("down")).withColumn("start", F.coalesce(F.sum("d").over(before), F.lit(0.0)))
        sure = mass.filter(F.abs(F.col("start") + F.col("d")) > limit + eps).select(*group)
        open_ = mass.filter((F.abs(F.col("start") + F.col("d")) <= limit + eps) & ((F.col("start") + F.col("up") > limit - eps) | (F.col("start") + F.col("down") < -limit + eps))).select(*group, "bucket", "start")
        inside = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        fine = points.join(open_, [*group, "bucket"]).withColumn("at", F.col("start") + F.sum("d").over(inside)).filter(F.abs("at") > limit + eps).select(*group)
        back = F.element_at(F.array(*map(F.lit, self.numeric)), F.col("c") + 1)
        return sure.unionByName(fine).distinct().select("run_id", F.col("load").alias("load_no"), back.alias("column_name"))

    def missing_counts(self, profile: DataFrame, summary: DataFrame) -> DataFrame:
        """(run, load, column) whose stated missing count is not the number missing; an absent entry states 0."""
        stated = summary.select("run_id", "load_no", F.col("missing_value_count_per_feature").alias("stated"))
        claim = F.coalesce(F.try_element_at("stated", F.col("column_name")), F.lit(0))
        return profile.filter(F.col("column_name").isin(self.numeric)).join(stated, ["run_id", "load_no"]).filter(claim != F.col("missing")).select("run_id", "load_no", "column_name")


def load_findings(df: DataFrame, summary: DataFrame, schema: DataFrame, null_rate: float = NULL_RATE, shift: float = SHIFT) -> DataFrame:
    """run_id, load_no, column_name, finding."""
    profiler = LoadProfile(df, bounds=schema_bounds(schema)).keep()
    profile = written(profiler.by_load(), "profile")
    changes = profiler.changes(profile)
    keys = ["run_id", "load_no", "column_name"]
    tag = lambda d, name: d.select(*keys, F.lit(name).alias("finding"))
    local = changes.select(
        *keys,
        F.explode(F.array_compact(F.array(
            F.when((F.col("violations") > 0) & F.col("column_name").isin(profiler.numeric), "range"),
            F.when((F.col("violations") > 0) & ~F.col("column_name").isin(profiler.numeric), "pattern"),
            F.when((F.abs("null_rate_change") > null_rate + 1e-12) & F.col("column_name").isin(profiler.numeric), "null_rate"),
        ))).alias("finding"),
    )
    parts = [local, tag(profiler.shifts(changes, shift), "shift"), tag(profiler.missing_counts(profile, summary), "missing_count")]
    return reduce(DataFrame.unionByName, parts).select(F.col("run_id").cast("bigint").alias("run_id"), F.col("load_no").cast("int").alias("load_no"), "column_name", "finding").distinct()


def leaves(df: DataFrame, groups: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """The numeric leaves of a table's structs, and the flags and texts, by dotted name."""
    from pyspark.sql import types as T

    found = [(f"{g.name}.{f.name}", f.dataType) for g in df.schema if isinstance(g.dataType, T.StructType) and (groups is None or g.name in groups) for f in g.dataType]
    numeric = [n for n, t in found if isinstance(t, T.NumericType)]
    return numeric, [n for n, t in found if isinstance(t, (T.StringType, T.BooleanType))]


def column_profile(df: DataFrame, schema: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """The whole profile: a row per run, load and column, for every leaf of the table's structs."""
    numeric, others = leaves(df, groups)
    profiler = LoadProfile(df, numeric, {n: PATTERNS.get(n) for n in others}, schema_bounds(schema)).keep()
    keys = ["run_id", "load_no", "column_name"]
    out = profiler.changes().join(profiler.distinct_counts(), keys, "left")
    return out.select(*keys, "n", "missing", "null_rate", "low", "high", "violations", "summed", F.col("mean"), F.sqrt("variance").alias("deviation"), "null_rate_change", "standardised_difference", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))
