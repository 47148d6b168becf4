"""Joins of intervals within an entity: by overlap or small gap, best match, band equality.

An interval is keyed by each cell of the time axis that it touches, widened by the tolerance, so that the join is an
equi-join on (entity, cell); a pair is met once for each shared cell and kept in the first one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cells(df: DataFrame, side: str, cell: float, widen: float) -> DataFrame:
    lo, hi = F.floor((F.col("start_seconds") - widen) / cell), F.floor((F.col("end_seconds") + widen) / cell)
    named = df.select("entity", F.col("id").alias(f"{side}_id"), F.col("start_seconds").alias(f"{side}_start"), F.col("end_seconds").alias(f"{side}_end"), lo.alias(f"{side}_cell"), F.explode(F.sequence(lo, hi)).alias("cell"))
    return named


def overlap(a: str, b: str) -> Column:
    return F.least(f"{a}_end", f"{b}_end") - F.greatest(f"{a}_start", f"{b}_start")


def near_pairs(left: DataFrame, right: DataFrame, gap: float, cell: float) -> DataFrame:
    """Pairs of (entity, id, start_seconds, end_seconds) rows that overlap or lie at most `gap` apart."""
    both = _cells(left, "l", cell, gap).join(_cells(right, "r", cell, 0.0), ["entity", "cell"])
    once = F.col("cell") == F.greatest("l_cell", "r_cell")
    shared = overlap("l", "r")
    return both.filter(once & (shared >= -gap)).select("entity", "l_id", "r_id", "l_start", "l_end", "r_start", "r_end", F.round(F.greatest(F.lit(0.0), shared), 6).alias("overlap"), F.round(F.greatest(F.lit(0.0), -shared), 6).alias("gap"))


def best_match(left: DataFrame, right: DataFrame, gap: float, cell: float) -> DataFrame:
    """For each left interval the right one that overlaps most; then by share, middle distance, start and id."""
    return best_of(near_pairs(left, right, gap, cell))


def best_of(pairs: DataFrame) -> DataFrame:
    """The best right interval of each left one among near pairs."""
    share = F.col("overlap") / F.greatest(F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start")), F.lit(1e-9))
    middle = F.abs((F.col("l_start") + F.col("l_end") - F.col("r_start") - F.col("r_end")) / 2)
    w = Window.partitionBy("entity", "l_id").orderBy(F.desc("overlap"), F.desc(F.round(share, 6)), F.round(middle, 6), "r_start", "r_id")
    return pairs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def unmatched(left: DataFrame, right: DataFrame, gap: float, cell: float) -> DataFrame:
    return left.join(near_pairs(left, right, gap, cell).select("entity", F.col("l_id").alias("id")).distinct(), ["entity", "id"], "left_anti")


def band_equal(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Pairs whose starts differ by at most `tolerance`, through cells of that width."""
    cell = lambda c: F.floor(c / tolerance)
    a = left.select("entity", F.col("id").alias("l_id"), F.col("start_seconds").alias("l_start")).withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: cell(F.col("l_start")) + i)))
    b = right.select("entity", F.col("id").alias("r_id"), F.col("start_seconds").alias("r_start"), cell(F.col("start_seconds")).alias("cell"))
    return a.join(b, ["entity", "cell"]).filter(F.abs(F.col("l_start") - F.col("r_start")) <= tolerance + 1e-9).select("entity", "l_id", "r_id")
