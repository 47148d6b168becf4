"""Audits of flat labelled feature tables: statistics by class, class differences, correlation, leakage, duplicates.

A column's values are unpivoted once and aggregated by (column[, class]), with partial aggregation before the shuffle;
statistics for all rows and for each class come from one GROUPING SETS pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelgrain.functions.scalars import number
from reelgrain.functions.text import present_lower
from reelgrain.session import written

#: Terms that hint at a label or at where a file comes from, looked for in every column's values.
SOURCE_TERMS = ("real", "ai", "fake", "generated", "ai_generated", "deepfake", "kaggle", "personal", "external", "manual_source", "self_recorded")


def flatten(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Struct leaves to dotted columns, in order of name; lists and maps stay as they are."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [leaf for f in schema for leaf in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)])]

    paths = sorted(leaves(df.schema, ()), key=lambda p: (".".join(p) not in keep, ".".join(p)))
    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(".".join(p)) for p in paths))


def unpivoted(df: DataFrame, columns: Sequence[str], label: str, kind: str = "string") -> DataFrame:
    """label, column_name, value of the named columns; values that mean missing, and as doubles those that are no numbers, are null."""
    types = dict(df.dtypes)
    as_number = lambda c: number(F.col(f"`{c}`")) if types[c] == "string" else finite(F.col(f"`{c}`").cast("double"))
    own = lambda c: present_text(F.col(f"`{c}`").cast("string")) if kind == "string" else as_number(c)
    return df.select(F.col(f"`{label}`").alias("label"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), own(c).alias("value")) for c in columns))))


def present_text(c: Column) -> Column:
    return F.when(present_lower(c).isNotNull(), c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def quantiles(counts: DataFrame, keys: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) from (keys, value, k) counts, by running sums and not by a map of all values."""
    placed = running(counts, keys, "value", "k")
    whole = counts.groupBy(*keys).agg(F.sum("k").alias("_n"))
    rows = placed.join(whole, list(keys))
    picks = []
    for name, q in shares.items():
        place = (F.col("_n") - 1) * F.lit(q)
        held = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("k")), F.col("value")))
        low, high = held(F.floor(place)), held(F.ceil(place))
        share = F.max(place - F.floor(place))
        picks.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*keys).agg(*picks)


def describe(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Descriptive statistics of all rows (class `*`) and of each class. Values are counted once per column and class; everything follows from the counts."""
    rows = unpivoted(df, columns, label, "double").withColumn("label", F.coalesce("label", F.lit("?")))
    counted = rows.groupBy("column_name", "label", "value").agg(F.count(F.lit(1)).alias("k"))
    both = counted.select("column_name", F.explode(F.array(F.col("label"), F.lit("*"))).alias("class"), "value", "k").groupBy("column_name", "class", "value").agg(F.sum("k").alias("k"))
    keys, v, k = ["column_name", "class"], F.col("value"), F.col("k")
    kept = written(both, "counts")
    sums = kept.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), k)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(v.isNull(), k)), F.lit(0)).alias("missing"), F.sum(v * k).alias("_s"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("distinct_values"),
    ).withColumn("mean", F.col("_s") / F.nullif(F.col("n"), F.lit(0)))
    spread = kept.filter("value is not null").join(sums.select(*keys, "n", "mean"), keys).groupBy(*keys).agg(F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * k) / F.max("n")).alias("deviation"))
    places = quantiles(kept.filter("value is not null"), keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = sums.join(spread, keys, "left").join(places, keys, "left")
    return out.select(*keys, "n", "missing", "mean", "median", "deviation", "low", "high", "q1", "q3", "distinct_values", (F.col("q3") - F.col("q1")).alias("iqr"))


def compare_classes(df: DataFrame, columns: Sequence[str], label: str, one: str, two: str) -> DataFrame:
    """Class `two` against class `one` for each column: means, medians, pooled deviation, effect, point-biserial r, overlap of ranges, rank test.

    Values are counted once per column and class; everything follows from the counts. A column with an empty class has a row
    of nulls whose `comparison` is `insufficient class data`. The greatest difference of means comes first.
    """
    rows = unpivoted(df, columns, label, "double").filter(F.col("label").isin(one, two) & F.col("value").isNotNull())
    counts = written(rows.groupBy("column_name", "label", "value").agg(F.count(F.lit(1)).alias("k")), "counts")
    v, k, y = F.col("value"), F.col("k"), (F.col("label") == two).cast("double")
    of = lambda c, x: F.when(F.col("label") == c, x)
    sums = counts.groupBy("column_name").agg(
        *(x.alias(f"{n}{i}") for i, c in ((1, one), (2, two)) for n, x in (("n", F.coalesce(F.sum(of(c, k)), F.lit(0))), ("s", F.sum(of(c, v * k))), ("low", F.min(of(c, v))), ("high", F.max(of(c, v))))),
        F.sum(k).alias("_n"), F.sum(v * k).alias("_s"),
    ).withColumns({"mean1": F.col("s1") / F.nullif(F.col("n1"), F.lit(0)), "mean2": F.col("s2") / F.nullif(F.col("n2"), F.lit(0)), "_mean": F.col("_s") / F.col("_n")})
    off = lambda m: (v - F.col(m)) * (v - F.col(m)) * k
    squares = counts.join(F.broadcast(sums), "column_name").groupBy("column_name").agg(F.sum(of(one, off("mean1"))).alias("q1"), F.sum(of(two, off("mean2"))).alias("q2"), F.sum(off("_mean")).alias("_q"), F.sum((v - F.col("_mean")) * (y - F.col("n2") / F.col("_n")) * k).alias("_c"))
    medians = quantiles(counts, ["column_name", "label"], {"median": 0.5}).groupBy("column_name").agg(F.max(of(one, F.col("median"))).alias("median1"), F.max(of(two, F.col("median"))).alias("median2"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    whole = F.broadcast(names).join(sums.join(squares, "column_name").join(medians, "column_name"), "column_name", "left")
    n1, n2 = (F.coalesce(f"n{i}", F.lit(0)) for i in (1, 2))
    there = (n1 > 0) & (n2 > 0)
    share = F.col("n2") / F.col("_n")
    pooled = F.when((n1 >= 2) & (n2 >= 2), F.sqrt(((F.col("n1") - 1) * F.col("q1") / F.col("n1") + (F.col("n2") - 1) * F.col("q2") / F.col("n2")) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0))))
    biserial = F.col("_c") / F.nullif(F.sqrt(F.col("_q")) * F.sqrt(F.col("_n") * share * (1 - share)), F.lit(0.0))
    only = lambda c: F.when(there, c)
    difference = F.col("mean2") - F.col("mean1")
    out = whole.join(rank_test(df, columns, label, one, two).select("column_name", "z"), "column_name", "left").select(
        "column_name", n1.alias("n1"), n2.alias("n2"), only(F.col("mean1")).alias("mean1"), only(F.col("mean2")).alias("mean2"), only(difference).alias("mean_difference"), only(F.abs(difference)).alias("absolute_difference"),
        only(F.col("median1")).alias("median1"), only(F.col("median2")).alias("median2"), only(F.col("median2") - F.col("median1")).alias("median_difference"), only(pooled).alias("pooled_deviation"), only(difference / F.nullif(pooled, F.lit(0.0))).alias("effect"),
        only(biserial).alias("point_biserial"), F.when(~there, "unavailable").when((F.col("high1") < F.col("low2")) | (F.col("high2") < F.col("low1")), "no_observed_range_overlap").otherwise("observed_ranges_overlap").alias("overlap"),
        F.when(~there, "insufficient class data").when(F.col("z").isNull(), "unavailable").otherwise("available").alias("comparison"), only(F.col("z")).alias("z"), only(two_sided_p(F.col("z"))).alias("p"),
    )
    return out.orderBy(F.desc(F.coalesce("absolute_difference", F.lit(0.0))), "column_name")


def running(df: DataFrame, keys: Sequence[str], order: str, value: str, buckets: int = 1024) -> DataFrame:
    """`before`: the sum of `value` over smaller `order` within the keys, through sums by bucket of the order's range."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    rows = df.join(ends, keys).withColumn("_b", F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets), F.lit(0)))
    past = lambda *k: Window.partitionBy(*k)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(past(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(past(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.drop("_s"), [*keys, "_b"]).withColumn("before", F.col("_start") + inside).drop("_b", "_lo", "_hi", "_start")


def rank_test(df: DataFrame, columns: Sequence[str], label: str, one: str, two: str) -> DataFrame:
    """Mann-Whitney U by average ranks over ties, with the normal approximation (no tie or continuity correction)."""
    rows = unpivoted(df, columns, label, "double").filter(F.col("label").isin(one, two) & F.col("value").isNotNull())
    counts = rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("label") == one).alias("k1"))
    ranked = running(counts, ["column_name"], "value", "k").withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
    t = ranked.groupBy("column_name").agg(F.sum(F.col("rank") * F.col("k1")).alias("r1"), F.sum("k1").alias("n1"), (F.sum("k") - F.sum("k1")).alias("n2")).filter("n1 >= 2 and n2 >= 2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    z = (u - F.col("n1") * F.col("n2") / 2) / F.sqrt(F.col("n1").cast("double") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return t.select("column_name", "n1", "n2", u.alias("u"), z.alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """erfc(|z| / sqrt 2); one value per column compared."""
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """Pearson's r of every pair of columns over the rows where both are present; null where there are fewer than two or a variance is 0.

    Each task sums matrices (counts, sums, squares, products) about one value near each column's middle and gives a row per
    pair; these are added. Work is one matrix product per batch, however many pairs there are.
    """
    own = df.select(*(finite(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    middle = own.agg(*(F.percentile_approx(f"c{i}", 0.5).alias(f"c{i}") for i in range(len(columns)))).first()
    centre = np.array([0.0 if m is None else m for m in middle])
    pairs = np.array(list(combinations(range(len(columns)), 2)), np.int32).reshape(-1, 2)
    i, j = pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(pairs)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            n, s, q, p = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
            total += np.stack([n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, total)], names=["i", "j", "n", "sx", "sy", "qx", "qy", "p"])

    sums = own.mapInArrow(run, "i int, j int, n double, sx double, sy double, qx double, qy double, p double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "p")))
    spread = lambda q, s: F.when(F.col(q) - F.col(s) * F.col(s) / F.col("n") > 1e-12 * F.col(q), F.col(q) - F.col(s) * F.col(s) / F.col("n"))
    r = F.when(F.col("n") >= 2, (F.col("p") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("qx", "sx")) / F.sqrt(spread("qy", "sy")))
    name = lambda k: F.element_at(F.array(*map(F.lit, columns)), F.col(k) + 1)
    out = sums.select(F.least(name("i"), name("j")).alias("left_column"), F.greatest(name("i"), name("j")).alias("right_column"), F.col("n").cast("bigint").alias("n"), r.alias("r"))
    return out if least <= 0 else out.filter(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "left_column", "right_column")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key, rows beyond the first of their value; missing values do not repeat. `*` is the whole row."""
    parts = []
    for k in keys:
        rows = df.select(present_text(F.col(f"`{k}`").cast("string")).alias("k")).filter("k is not null")
        parts.append(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")).select(F.lit(k).alias("key"), "repeated"))
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    parts.append(df.select(whole.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")).select(F.lit("*").alias("key"), "repeated"))
    return reduce(DataFrame.unionByName, parts)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class, and the least class as a share of the greatest."""
    counts = df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("label is not null")
    w = Window.partitionBy(F.lit(1))  # a row per class
    return counts.select("label", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.round(F.min("n").over(w) / F.max("n").over(w), 6).alias("balance"))
