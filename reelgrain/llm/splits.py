"""Splits that never part records sharing an entity.

Records are linked through their source and their digest. All records of a source are one node from the start and all
records of a digest are folded to (digest, smallest source), so that edges exist only between sources that share a
digest: a star per digest, never the pairs in it. Components come from alternating large-star and small-star steps over
those edges, each written to the shared folder. A component's size is summed over sources before any record is joined,
so a hot source or digest is one row of each join's small side.

Labels and generators are spread alike: a record's stratum is its pair of label (read by label_alias) and generator
(trimmed, lower case; missing is a value of its own). Components larger than `big_share` of all records (at most
1 / big_share of them) are placed one by one. The rest are hashed, by the stratum that most of their records have, into
at most about BUCKETS buckets. Counts by component or bucket and stratum decide on the driver: each goes, largest
first, where the squared deviations from target of size, labels, generators and strata grow least, and then moves for as
long as that lowers them, in at most PASSES passes.

Defined results. The STRATA commonest strata count one by one and the others as one. Missing sources (null, blank, placeholders) and texts that are no digest link nothing; a record with
neither is alone. Repeated records are kept and count. An empty table gives an empty result. Columns that are not named
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.text import digest_hex, present_lower, trimmed_lower
from reelgrain.session import small_rows, written

MOST_ROUNDS = 60
STRATA, BUCKETS, PASSES = 500, 4096, 6


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are tied to the least node of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are tied to the least of them; edges run from the greater node to the lesser."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
    return tied.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component; nodes without edges are absent."""
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = mark(now)
    for _ in range(MOST_ROUNDS):
        now = written(small_star(large_star(now)), "stars")
        last, seen = seen, mark(now)
        if last == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def _keyed(manifest: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return manifest.select("entry_id", *keep, present_lower("source").alias("src"), F.unhex(digest_hex("video_sha256")).alias("dig"))


def groups(manifest: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """entry_id, `keep`, group_key, group_size of every record. A lone record without source and digest has a null key."""
    rows = _keyed(manifest, keep)
    sourced, bare = rows.filter("src is not null"), rows.filter("src is null")
    pairs = sourced.filter("dig is not null").groupBy("dig", "src").agg(F.lit(1).alias("one")).select("dig", "src")
    first = written(pairs.groupBy("dig").agg(F.min("src").alias("first_src"), F.max("src").alias("last_src")), "digests")
    wide = first.filter("first_src < last_src").select("dig", "first_src")
    edges = pairs.join(wide, "dig").filter("src <> first_src").select(F.col("src").alias("u"), F.col("first_src").alias("v"))
    roots = components(edges)
    # records without a source follow their digest's first source, or the digest itself
    by_digest = bare.filter("dig is not null").groupBy("dig").agg(F.count(F.lit(1)).alias("n")).join(first.select("dig", F.col("first_src").alias("src")), "dig", "left")
    by_source = sourced.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    per_source = written(
        by_source.unionByName(by_digest.filter("src is not null").select("src", "n")).groupBy("src").agg(F.sum("n").alias("n"))
        .join(roots, F.col("src") == F.col("node"), "left").select("src", F.coalesce("root", "src").alias("group_key"), "n"),
        "sources",
    )
    size = per_source.groupBy("group_key").agg(F.sum("n").alias("group_size"))
    keys = per_source.select("src", "group_key").join(size, "group_key").select("src", "group_key", "group_size")
    digest_keys = by_digest.join(keys, "src", "left").select("dig", F.coalesce("group_key", F.lower(F.hex("dig"))).alias("group_key"), F.coalesce("group_size", "n").alias("group_size"))
    parts = [
        sourced.join(keys, "src").select("entry_id", *keep, "group_key", "group_size"),
        bare.filter("dig is not null").join(digest_keys, "dig").select("entry_id", *keep, "group_key", "group_size"),
        bare.filter("dig is null").select("entry_id", *keep, F.lit(None).cast("string").alias("group_key"), F.lit(1).cast("bigint").alias("group_size")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def linked(manifest: DataFrame) -> DataFrame:
    """entry_id, group_key of every record that must stay with at least one other."""
    return groups(manifest).filter("group_size >= 2").select("entry_id", "group_key")


def _strata(manifest: DataFrame, aliases: DataFrame | None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The manifest with the number of each record's stratum, and the (label, generator) of each number; the last is all others."""
    columns, none = set(manifest.columns), F.lit("")
    label = present_lower("expected_label") if "expected_label" in columns else none
    maker = present_lower("generator_or_camera") if "generator_or_camera" in columns else none
    rows = manifest.withColumn("_label", F.coalesce(label, none)).withColumn("_maker", F.coalesce(maker, none))
    if aliases is not None and "expected_label" in columns:
        known = aliases.groupBy(trimmed_lower("alias").alias("_label")).agg(F.min("expected_label").alias("_known"))
        rows = rows.join(F.broadcast(known), "_label", "left").withColumn("_label", F.coalesce("_known", none)).drop("_known")
    common = rows.groupBy("_label", "_maker").count().orderBy(F.desc("count"), "_label", "_maker").limit(STRATA).collect()
    pairs = [(r[0], r[1]) for r in common]
    numbers = manifest.sparkSession.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "_label string, _maker string, stratum int")
    rows = rows.join(F.broadcast(numbers), ["_label", "_maker"], "left")
    return rows.withColumn("stratum", F.coalesce("stratum", F.lit(len(pairs)))), [*pairs, ("\0", "\0")]


def balanced(counts: np.ndarray, pairs: list[tuple[str, str]], shares: list[float]) -> list[int]:
    """The split of each row of counts (units by strata), near the shares in size, labels, generators and strata."""
    kinds = [np.ones((len(pairs), 1))]
    for part in ([p[0] for p in pairs], [p[1] for p in pairs], list(range(len(pairs)))):
        kinds.append((np.array(part)[:, None] == np.array(sorted(set(part)))[None, :]).astype(float))
    parts = counts.astype(float) @ np.hstack(kinds)
    share = np.array(shares)
    target = share[:, None] * parts.sum(axis=0)[None, :]
    weight = np.divide(1.0, target, out=np.zeros_like(target), where=target > 0)
    weight[share <= 0] = 1.0
    off, at = -target, [-1] * len(parts)
    order = np.argsort(-parts[:, 0], kind="stable")
    for _ in range(1 + PASSES):
        moved = False
        for k in order:
            u, was = parts[k], at[k]
            if was >= 0:
                off[was] -= u
            cost = ((2 * off + u) * u * weight).sum(axis=1)
            cost[share <= 0] = np.inf
            best = int(np.argmin(cost))
            if was >= 0 and cost[best] >= cost[was] - 1e-9:
                best = was
            off[best] += u
            moved |= best != was
            at[k] = best
        if not moved:
            break
    return at


def assign(manifest: DataFrame, targets: DataFrame, seed: int = 11, big_share: float = 0.002, aliases: DataFrame | None = None) -> DataFrame:
    """entry_id, group_key, split_name. Without `aliases` (label_alias) a label stands for itself, trimmed and in lower case."""
    spark = manifest.sparkSession
    shares = [(r[0], max(0.0, float(r[1] or 0))) for r in small_rows(targets.select("split_name", "target_share"))]
    whole = sum(s for _, s in shares)
    shares = [(n, s / whole if whole else 1 / len(shares)) for n, s in sorted(shares)]
    numbered, pairs = _strata(manifest, aliases)
    rows = written(groups(numbered, ("stratum",)).withColumn("unit", F.coalesce("group_key", F.concat(F.lit("#"), F.col("entry_id")))), "groups")
    total = rows.count()
    large = F.col("group_size") > big_share * total
    big = rows.filter(large).select("unit", "group_size").distinct().orderBy(F.desc("group_size"), "unit").collect()  # at most 1 / big_share rows
    fixed = spark.createDataFrame([(r[0], -1 - k) for k, r in enumerate(big)], "unit string, bucket int")
    each = max(4, BUCKETS // len(pairs))
    bucket = lambda stratum: (F.col(stratum) * each + F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(each))).cast("int")
    small = rows.filter(~large)
    shared = small.filter("group_size > 1")
    main = shared.groupBy("unit", "stratum").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.max(F.struct("n", F.col("stratum").alias("s")))["s"].alias("main"))
    columns = ["entry_id", "group_key", "stratum", "bucket"]
    rows = written(
        rows.filter(large).join(F.broadcast(fixed), "unit").select(columns)
        .unionByName(shared.join(main, "unit").withColumn("bucket", bucket("main")).select(columns))
        .unionByName(small.filter("group_size = 1").withColumn("bucket", bucket("stratum")).select(columns)),
        "buckets",
    )
    found = rows.groupBy("bucket", "stratum").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most (BUCKETS + 1 / big_share) x STRATA
    b, s, n = (found[c].to_numpy() for c in ("bucket", "stratum", "n"))
    units, inverse = np.unique(b, return_inverse=True)
    counts = np.zeros((len(units), len(pairs)), dtype=np.int64)
    np.add.at(counts, (inverse, s), n)
    at = balanced(counts, pairs, [x for _, x in shares]) if shares and len(units) else []
    named = spark.createDataFrame([(int(u), shares[k][0]) for u, k in zip(units, at)], "bucket int, split_name string")
    return rows.join(F.broadcast(named), "bucket", "left").select("entry_id", "group_key", "split_name")
