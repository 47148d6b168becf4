"""Candidates of several domains to one timeline: union with roles, merged events with their domains, rule rows with ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.functions.scalars import half_even
from reelgrain.operators import sequence


def candidates(sources: Mapping[str, DataFrame], groups: Mapping[str, str], anchors: Sequence[str]) -> DataFrame:
    """One table of (entity, id, start_seconds, end_seconds) rows of each domain, with its group, role and an id in order of source and time."""
    parts = []
    for k, (domain, df) in enumerate(sources.items()):
        role = F.lit("anchor" if domain in anchors else "supporting")
        parts.append(df.select("entity", "id", "start_seconds", "end_seconds", F.lit(domain).alias("domain"), F.lit(groups.get(domain, domain)).alias("domain_group"), role.alias("role"), F.lit(k).alias("source_order")))
    whole = reduce(DataFrame.unionByName, parts)
    n = F.row_number().over(Window.partitionBy("entity").orderBy("source_order", "start_seconds", "id"))
    return whole.withColumn("candidate_id", F.format_string("cand-%05d", n))


def events(found: DataFrame, gap: float, span: float) -> DataFrame:
    """Merged anchors with their extent, domains, groups and whether several groups agree."""
    anchors = found.filter("role = 'anchor'")
    member = sequence.merge_anchors(anchors, gap, span)
    rows = anchors.join(member, ["entity", "id"])
    out = rows.groupBy("entity", "event").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.count(F.lit(1)).alias("candidates"),
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.count_distinct("domain_group").alias("groups"),
    )
    level = F.when(F.col("groups") > 1, "several_groups").when(F.col("candidates") > 1, "one_group").otherwise("single")
    return out.withColumn("agreement", level)


def rule_rows(df: DataFrame, key: str, order: str, rules: Mapping[str, Column]) -> DataFrame:
    """A row per fired rule, numbered within the key in order of row and rule."""
    fired = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("k"), F.lit(name).alias("rule"))) for i, (name, c) in enumerate(rules.items()))))
    rows = df.select(key, order, F.inline(fired))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order, "k"))
    return rows.select(key, order, "rule", F.format_string("obs-%05d", n).alias("observation_id"))


def latest_by_name(sidecar: DataFrame, name: str, order: str, values: Sequence[str]) -> DataFrame:
    """name in lower case -> the values of its last row."""
    return sidecar.groupBy(F.lower(name).alias("name")).agg(F.max_by(F.struct(*values), order).alias("v")).select("name", *(F.col(f"v.{c}").alias(c) for c in values))


def unique_match(left: DataFrame, right: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Rows joined by name in lower case where the name is there exactly once."""
    once = right.groupBy(F.lower(name).alias("_n")).agg(F.count(F.lit(1)).alias("_k"), *(F.first(c).alias(f"matched_{c}") for c in values)).filter("_k = 1").drop("_k")
    return left.withColumn("_n", F.lower(name)).join(once, "_n").drop("_n")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """What only one side has, with repeats, and how often."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def scene_frames(scenes: DataFrame, short: float, most: int | None = None) -> DataFrame:
    """Times to show of each scene: start, middle and end, or the middle alone of a short one; of an entity at most the first `most`."""
    a, b = F.col("start_seconds"), F.col("end_seconds")
    at = lambda x: half_even(F.bround(x, 7), 3)
    times = F.when(b - a < short, F.array(at((a + b) / 2))).otherwise(F.array(at(a), at((a + b) / 2), at(b)))
    rows = scenes.select("entity", "scene_index", F.explode(F.array_distinct(times)).alias("seconds"))
    if most is None:
        return rows
    n = F.row_number().over(Window.partitionBy("entity").orderBy("scene_index", "seconds"))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def distinct_strings(c: Column) -> Column:
    """Strings of an array once each, whatever their case and spacing; the first spelling stays."""
    norm = lambda x: F.lower(F.regexp_replace(F.btrim(x), r"\s+", " "))
    return F.filter(c, lambda x, i: F.array_position(F.transform(c, norm), norm(x)) == i + 1)
