"""A sample that matches target proportions of a two-level category tree.

Counts per category are map-side combined; the tree (as large as the target table, which is bounded metadata) is
allocated top-down on the driver: a label's quota follows its share, is capped by what its leaves hold, and what a leaf
cannot give passes to its siblings first and to cousins only when the whole label is exhausted. Leaves are drawn by the
dense rank of a seeded permutation. No category is ranked in one task: rows fall into 4,096 ranges of the permutation,
whole ranges below a leaf's cut are taken, and only the range at the cut is ranked.

Defined results. Rows whose label is unknown or whose category has no target are never drawn. Repeated rows count and
can all be drawn. Ties of the permutation are broken by entry_id. An empty table gives an empty sample and reports each
category with a positive need. Target rows with a null share or minimum count as 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.functions.text import trimmed_lower

RANGES = 4096
MOST_TARGETS = 100_000


@dataclass(frozen=True)
class Leaf:
    label: str
    generator: str
    share: float
    least: int
    available: int


def spread(quota: int, weights: Sequence[float], least: Sequence[int], caps: Sequence[int]) -> list[int]:
    """Whole numbers near quota * weight, at least `least`, at most `caps`; their sum is the quota unless caps forbid it."""
    got = [min(a, c) for a, c in zip(least, caps)]
    total = sum(weights) or 1.0
    ideal = [quota * w / total for w in weights]
    got = [min(c, max(g, int(i + 1e-9))) for g, i, c in zip(got, ideal, caps)]
    while (left := quota - sum(got)) > 0 and (open_ := [k for k in range(len(got)) if got[k] < caps[k]]):
        mass = sum(weights[k] for k in open_)
        extra = {k: left * (weights[k] / mass if mass else 1 / len(open_)) for k in open_}
        step = {k: min(caps[k] - got[k], int(x)) for k, x in extra.items()}
        if not any(step.values()):
            order = sorted(open_, key=lambda k: (got[k] - ideal[k], -weights[k], k))
            step = {k: 1 for k in order[:left]}
        for k, x in step.items():
            got[k] += x
    while (over := sum(got) - quota) > 0 and (open_ := [k for k in range(len(got)) if got[k] > min(least[k], caps[k])]):
        worst = max(open_, key=lambda k: (got[k] - ideal[k], k))
        got[worst] -= min(over, max(1, int(got[worst] - max(ideal[worst], least[worst]))), got[worst] - min(least[worst], caps[worst]))
    return got


def allocate(leaves: Sequence[Leaf], size: int) -> list[int]:
    labels = sorted({x.label for x in leaves})
    groups = [[k for k, x in enumerate(leaves) if x.label == label] for label in labels]
    quotas = spread(
        size,
        [sum(leaves[k].share for k in g) for g in groups],
        [sum(min(leaves[k].least, leaves[k].available) for k in g) for g in groups],
        [sum(leaves[k].available for k in g) for g in groups],
    )
    out = [0] * len(leaves)
    for g, quota in zip(groups, quotas):
        own = spread(quota, [leaves[k].share for k in g], [leaves[k].least for k in g], [leaves[k].available for k in g])
        for k, n in zip(g, own):
            out[k] = n
    return out


def categorised(manifest: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """entry_id, expected_label, generator_or_camera of the rows whose category has a target."""
    known = labels.select(F.col("alias"), F.col("expected_label").alias("label")).dropDuplicates(["alias"])
    wanted = targets.select(F.col("expected_label").alias("label"), F.col("generator_or_camera").alias("generator")).distinct()
    rows = manifest.select("entry_id", trimmed_lower("expected_label").alias("alias"), trimmed_lower("generator_or_camera").alias("generator"))
    return rows.join(known, "alias").join(wanted, ["label", "generator"]).select("entry_id", "label", "generator")


def targets_list(targets: DataFrame) -> tuple[list[tuple[str, str, float, int]], int]:
    rows = targets.select("expected_label", "generator_or_camera", "target_share", "min_rows", "sample_size").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target categories")
    return [(r[0], r[1], float(r[2] or 0), int(r[3] or 0)) for r in rows], max((int(r[4] or 0) for r in rows), default=0)


def plan(manifest: DataFrame, labels: DataFrame, targets: DataFrame) -> tuple[list[Leaf], list[int], int]:
    """The leaves with what is available, the rows allocated to each, and the sample size."""
    wanted, size = targets_list(targets)
    counts = {(r[0], r[1]): r[2] for r in categorised(manifest, labels, targets).groupBy("label", "generator").count().collect()}  # at most a row per target
    leaves = [Leaf(label, generator, share, least, counts.get((label, generator), 0)) for label, generator, share, least in wanted]
    return leaves, allocate(leaves, size), size


def need(leaf: Leaf, size: int) -> float:
    return float(max(leaf.least, round(leaf.share * size, 9)))


def report(manifest: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target category: what was wanted, what there is, what is drawn, and whether the rows suffice."""
    leaves, drawn, size = plan(manifest, labels, targets)
    rows = [(x.label, x.generator, x.share, x.least, need(x, size), x.available, n, x.available < need(x, size)) for x, n in zip(leaves, drawn)]
    return manifest.sparkSession.createDataFrame(rows, "expected_label string, generator_or_camera string, target_share double, min_rows bigint, needed double, available bigint, drawn bigint, unmet boolean")


def draw(manifest: DataFrame, labels: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """entry_id, expected_label, generator_or_camera, permuted_rank of the drawn rows."""
    leaves, drawn, _ = plan(manifest, labels, targets)
    spark = manifest.sparkSession
    quotas = spark.createDataFrame([(x.label, x.generator, n) for x, n in zip(leaves, drawn) if n], "label string, generator string, quota bigint")
    h = F.xxhash64("entry_id", F.lit(seed))
    rows = categorised(manifest, labels, targets).withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 52))
    before = Window.partitionBy("label", "generator").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        rows.groupBy("label", "generator", "range").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quotas, ["label", "generator"]).filter("before < quota")
    )
    kept = rows.join(cuts, ["label", "generator", "range"])
    own = Window.partitionBy("label", "generator", "range").orderBy("h", "entry_id")
    ranked = kept.withColumn("rank", F.col("before") + F.row_number().over(own)).filter("rank <= quota")
    return ranked.select("entry_id", F.col("label").alias("expected_label"), F.col("generator").alias("generator_or_camera"), F.col("rank").alias("permuted_rank"))
