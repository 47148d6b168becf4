"""Ordered samples of an entity: pairs, runs, scenes, windows, thinning, rankings.

Each operator takes the columns it works on as parameters and partitions by the entity, so one shuffle on the entity
serves a chain of them. Folds whose next step depends on the last decision stream over sorted partitions, so that no
entity's rows are held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _by(entity: str, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(*order)


def samples(events: DataFrame, entity: str = "user_id", at: str = "ts", tie: str = "event_id", value: str = "value") -> DataFrame:
    """entity, sample_index from 0, seconds since the entity's first sample, value."""
    w = _by(entity, at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return events.select(
        F.col(entity).alias("entity"), (F.row_number().over(w) - 1).alias("sample_index"),
        F.round((micros - F.min(micros).over(Window.partitionBy(entity))) / 1e6, 6).alias("seconds"), F.col(value).alias("value"), F.col(tie).alias("tie"), "event_type",
    )


def transitions(df: DataFrame) -> DataFrame:
    """Consecutive pairs of samples with their differences (a lag, not a self-join)."""
    w = _by("entity", "sample_index")
    before = {c: F.lag(c).over(w) for c in ("sample_index", "seconds", "value", "tie")}
    return (
        df.select(
            "entity", before["sample_index"].alias("from_index"), F.col("sample_index").alias("to_index"), before["seconds"].alias("start_seconds"), F.col("seconds").alias("end_seconds"),
            F.abs(F.col("value") - before["value"]).alias("difference"), F.bit_count(F.col("tie").bitwiseXOR(before["tie"])).alias("distance"), F.col("value").alias("after"), before["value"].alias("before"), "event_type",
        ).filter("from_index is not null")
    )


def classify(df: DataFrame, rules: Mapping[str, tuple[str, Column]], classes: Mapping[str, Column]) -> DataFrame:
    """Boolean classes and the list of the rules that fired. rules: name -> (class, condition); rules of a class count only if it holds."""
    df = df.withColumns(dict(classes))
    fired = F.array_compact(F.array(*(F.when(F.col(c) & condition, F.lit(name)) for name, (c, condition) in rules.items())))
    return df.withColumn("triggered_rules", fired)


def scenes(df: DataFrame, boundary: Column) -> DataFrame:
    """Segments between boundary transitions. A scene ends with its boundary, which counts in no scene's motion."""
    before = Window.partitionBy("entity").orderBy("from_index").rowsBetween(Window.unboundedPreceding, -1)
    flagged = df.withColumn("b", boundary).withColumn("scene_index", F.coalesce(F.sum(F.col("b").cast("int")).over(before), F.lit(0)))
    last = flagged.groupBy("entity").agg(F.max("scene_index").alias("s"), F.max_by("b", "from_index").alias("b"), F.max("end_seconds").alias("end"))
    tail = last.filter("b").select("entity", (F.col("s") + 1).alias("scene_index"), F.col("end").alias("start_seconds"), F.col("end").alias("end_seconds"), F.lit(1).cast("bigint").alias("sample_count"), F.lit(None).cast("double").alias("mean_difference"), F.lit(None).cast("double").alias("median_difference"), F.lit(None).cast("double").alias("max_difference"))
    own = flagged.groupBy("entity", "scene_index").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), (F.count_if(~F.col("b")) + 1).alias("sample_count"),
        *(f(F.when(~F.col("b"), F.col("difference"))).alias(f"{name}_difference") for name, f in (("mean", F.avg), ("median", F.median), ("max", F.max))),
    )
    return own.unionByName(tail)


def scene_of(df: DataFrame, found: DataFrame) -> DataFrame:
    """The first scene whose closed interval holds a transition's start; on a shared edge the earlier one. A merge of both in time order, no range join."""
    starts = found.select("entity", F.col("end_seconds").alias("t"), F.lit(1).alias("kind"), F.col("scene_index"), F.lit(None).cast("int").alias("to_index"))
    points = df.select("entity", F.col("start_seconds").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("scene_index"), "to_index")
    ahead = Window.partitionBy("entity").orderBy("t", "kind", "scene_index").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return starts.unionByName(points).withColumn("scene", F.first("scene_index", ignorenulls=True).over(ahead)).filter("kind = 0").select("entity", "to_index", F.col("scene").alias("scene_index"))


def islands(df: DataFrame, flag: Column, least: float, key: Sequence[str] = ("entity",), order: str = "from_index", adjacent: bool = False, least_count: int = 1) -> DataFrame:
    """Maximal runs of flagged rows that last at least `least` seconds and count `least_count`; with `adjacent`, a run also ends where from_index is not the last to_index."""
    w = Window.partitionBy(*key).orderBy(order)
    start = flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    if adjacent:
        start = start | (flag & (F.col("from_index") != F.lag("to_index").over(w)))
    rows = df.withColumn("run", F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(w)).filter(flag)
    out = rows.groupBy(*key, "run").agg(F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.count(F.lit(1)).alias("transition_count"), F.max("difference").alias("max_difference"), F.avg("difference").alias("mean_difference"))
    out = out.withColumn("duration", F.round(F.col("end_seconds") - F.col("start_seconds"), 6)).filter((F.col("duration") >= least) & (F.col("transition_count") >= least_count))
    return out.withColumn("interval_index", F.row_number().over(Window.partitionBy(*key).orderBy("start_seconds", "run"))).drop("run")


def sliding(df: DataFrame, size: int, hop: int) -> DataFrame:
    """Windows of `size` samples every `hop`; the last may be short, and none begins after one that reaches the end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    rows = df.select("entity", "sample_index", "seconds", "value", n.alias("n")).withColumn("last", F.ceil(F.greatest(F.lit(0), F.col("n") - size) / hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("sample_index") - size + 1) / hop))
    window = F.sequence(first.cast("int"), F.greatest(first, F.least(F.floor(F.col("sample_index") / hop), F.col("last"))).cast("int"))
    held = rows.select("*", F.explode(window).alias("window_index")).filter(F.col("window_index") * hop <= F.col("sample_index")).filter("window_index <= last")
    return held.groupBy("entity", "window_index").agg(
        F.min("sample_index").alias("first_sample"), F.count(F.lit(1)).alias("sample_count"), F.min("seconds").alias("start_seconds"), F.max("seconds").alias("end_seconds"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"), F.avg("value").alias("mean"),
    )


def zero_crossings(df: DataFrame, level: float = 0.0) -> DataFrame:
    """Share of neighbouring samples on different sides of a level."""
    side = F.col("value") < level
    changed = side != F.lag(side).over(_by("entity", "sample_index"))
    return df.select("entity", changed.alias("c")).groupBy("entity").agg(F.avg(F.col("c").cast("double")).alias("crossing_rate"))


def fold_sorted(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], step: Callable, schema: str) -> DataFrame:
    """A sequential fold over each key's rows in order, as a stream over sorted partitions.

    `step(state, key, arrays)` gets the rows of one key in one batch, and the state that the same key's rows before left
    (None at its start); it returns the new state and the columns of the output. No key's rows are held together, so a
    hot key costs one long task and no memory.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
            out: list[list] = [[] for _ in names]
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                state, found = step(state if keys[at] == last else None, keys[at], [x[at:end] for x in arrays])
                for column, values in zip(out, found):
                    column.extend(values)
                last, at = keys[at], end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    kept = df.select(key, *columns).filter(F.col(key).isNotNull())
    return kept.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def thin(df: DataFrame, rate: float, most: int) -> DataFrame:
    """Greedy thinning: a sample is kept if it lies 1 / rate after the last kept one, at most `most` of them."""

    def step(state, key, arrays):
        index, seconds = arrays
        nxt, n = state or (-np.inf, 0)
        kept, numbers, at = [], [], 0
        while n < most and (at := at + int(np.searchsorted(seconds[at:], nxt - 1e-9))) < len(seconds):
            kept.append(int(index[at]))
            numbers.append(n)
            nxt, n, at = seconds[at] + 1 / rate, n + 1, at + 1
        return (nxt, n), ([key] * len(kept), numbers, kept)

    return fold_sorted(df, "entity", ["sample_index"], ["sample_index", "seconds"], step, "entity bigint, kept_index int, sample_index int")


def timestamp_plan(df: DataFrame, duration: str, short: float = 10.0, few: int = 8, many: int = 12, tail: float = 0.05) -> DataFrame:
    """Evenly spaced times over a duration, three decimals, the last `tail` before the end, repeated ones once."""
    d = F.col(duration)
    end = F.greatest(F.lit(0.0), d - tail)
    n = F.when(d <= short, few).otherwise(many)
    times = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(F.least(end, i * end / (n - 1)), 3)))
    return df.filter(d > 0).withColumn("times", times)


def rank_by_metrics(df: DataFrame, metrics: Sequence[str], per_metric: int = 5, keep: int = 5, available_only: bool = True) -> DataFrame:
    """Rows that stand out in several metrics: rank and percentile in each, the metrics where a row is among the first `per_metric` as reasons, the mean percentile (over the available ones or over all), the best `keep`."""
    long = df.select("entity", "from_index", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics)))).filter("x is not null and not isnan(x)")
    w = Window.partitionBy("entity", "metric")
    ranked = long.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("x"), "from_index")), "n": F.count(F.lit(1)).over(w)})
    percentile = F.when(F.col("n") > 1, F.round(1 - (F.col("rank") - 1) / (F.col("n") - 1), 6)).otherwise(F.lit(1.0))
    total = F.round(F.sum("p"), 6) / (F.count("p") if available_only else F.lit(len(metrics)))
    whole = ranked.withColumn("p", percentile).groupBy("entity", "from_index").agg(total.alias("combined"), F.array_sort(F.collect_list(F.when(F.col("rank") <= per_metric, F.col("metric")))).alias("reasons"))
    best = Window.partitionBy("entity").orderBy(F.desc("combined"), F.desc(F.size("reasons")), "from_index")
    return whole.filter(F.size("reasons") > 0).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)


def rank_ratio_jumps(df: DataFrame, value: str = "rms", keep: int = 5, ratio: float = 3.0) -> DataFrame:
    """Neighbouring windows whose values differ most by ratio, in time order."""
    w = _by("entity", "window_index")
    a, b = F.col(value), F.lead(value).over(w)
    rows = df.withColumns({"next": b, "ratio": F.round(F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-9)), 6), "change": F.round(F.abs(a - b), 6)}).filter("next is not null")
    best = Window.partitionBy("entity").orderBy(F.desc("ratio"), F.desc("change"), "window_index")
    return rows.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= keep) & ((F.col("ratio") >= ratio) | (F.col("change") > 0))).select("entity", "window_index", "ratio", "change", "rank")


def merge_anchors(df: DataFrame, gap: float, span: float) -> DataFrame:
    """Intervals in time order to groups: one joins the open group if it begins within `gap` of the group's end and the group's whole span stays within `span`."""

    def step(state, key, arrays):
        group, first, last = state or (0, 0.0, 0.0)
        events = []
        for start, end in zip(arrays[0].tolist(), arrays[1].tolist()):
            reach = max(last, end)
            if group and max(0.0, start - last) <= gap + 1e-9 and reach - first <= span + 1e-9:
                last = reach
            else:
                group, first, last = group + 1, start, end
            events.append(group)
        return (group, first, last), ([key] * len(events), arrays[2].tolist(), events)

    return fold_sorted(df, "entity", ["start_seconds", "end_seconds", "id"], ["start_seconds", "end_seconds", "id"], step, "entity bigint, id bigint, event int")


def first_fit(df: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Intervals in time order to seeds: one joins the first seed that it overlaps by `least_share` of the shorter and whose region neighbours its own; seeds do not grow. Seeds that ended too long ago to overlap are let go."""

    def step(state, key, arrays):
        count, seeds = state or (0, [])
        events = []
        for start, end, row, column in zip(*(x.tolist() for x in arrays[:4])):
            seeds = [s for s in seeds if s[2] >= start]
            for number, s0, s1, r, c in seeds:
                shorter = max(min(end - start, s1 - s0), 1e-9)
                if (min(end, s1) - max(start, s0)) / shorter >= least_share and abs(r - row) <= 1 and abs(c - column) <= 1:
                    events.append(number)
                    break
            else:
                count += 1
                seeds.append((count, start, end, row, column))
                events.append(count)
        return (count, seeds), ([key] * len(events), arrays[4].tolist(), events)

    columns = ["start_seconds", "end_seconds", "row", "column", "id"]
    return fold_sorted(df, "entity", ["start_seconds", "end_seconds", "id"], columns, step, "entity bigint, id bigint, seed int")


def monotone_times(df: DataFrame, rate: float = 25.0) -> DataFrame:
    """A time for each frame: the reported one if it does not fall behind, else the frame number over the rate if that does not, else the time before, else 0."""

    def step(state, key, arrays):
        last, times, sources = state, [], []
        for index, reported in zip(arrays[0].tolist(), arrays[1].tolist()):
            guess = index / rate
            if reported is not None and reported == reported and reported >= 0 and (last is None or reported >= last):
                last, source = reported, "reported"
            elif last is None or guess >= last:
                last, source = guess, "frame_number"
            else:
                source = "previous"
            times.append(last)
            sources.append(source)
        return last, ([key] * len(times), arrays[0].tolist(), times, sources)

    return fold_sorted(df, "entity", ["sample_index"], ["sample_index", "seconds"], step, "entity bigint, sample_index int, seconds double, source string")


def clip_start(duration: Column, length: float = 3.0, seed: int = 42) -> Column:
    """Where a clip of `length` seconds begins: a whole second, the same share of what is left for every row."""
    import random

    return F.when(duration <= length, 0.0).otherwise(F.floor((duration - length) * random.Random(seed).random()).cast("double"))


def size_ladder(df: DataFrame, key: str, rungs: Sequence[tuple[str, Column]], preferred: int, hard: int) -> DataFrame:
    """The first rung (a named, smaller and smaller rendering) whose text fits in `preferred` bytes, else the smallest; `fits` tells whether it is within `hard`."""
    texts = F.array(*(F.struct(F.lit(i).alias("rung"), F.lit(name).alias("name"), F.octet_length(c).alias("bytes")) for i, (name, c) in enumerate(rungs)))
    fitting = F.get(F.filter(texts, lambda x: x["bytes"] <= preferred), F.lit(0))
    chosen = F.coalesce(fitting, F.get(F.array_sort(texts, lambda a, b: (a["bytes"] - b["bytes"]).cast("int")), F.lit(0)))
    return df.select(key, chosen.alias("c")).select(key, "c.name", "c.bytes", (F.col("c.bytes") <= hard).alias("fits"))


def best_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The first `keep` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= keep)


def balanced_top(df: DataFrame, key: str, domain: str, order: Sequence[Column], caps: Mapping[str, int], most: int) -> DataFrame:
    """The best of each domain first, then the best of all within each domain's cap, `most` in all."""
    rows = df.withColumn("domain_rank", F.row_number().over(Window.partitionBy(key, domain).orderBy(*order)))
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col(domain)), F.lit(most))
    first = F.when(F.col("domain_rank") == 1, 0).otherwise(1)
    w = Window.partitionBy(key).orderBy(first, F.when(first == 0, F.col(domain)), *order)
    return rows.filter(F.col("domain_rank") <= cap).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def vector_differences(df: DataFrame, order: str = "vec_id", vector: str = "embedding", key: str = "label") -> DataFrame:
    """First differences (Euclidean length and cosine similarity to the vector before) and their change."""
    w = Window.partitionBy(key).orderBy(order)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(key, order, v.alias("v")).withColumn("p", F.lag("v").over(w))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(F.zip_with("v", "p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    cosine = dot(F.col("v"), F.col("p")) / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("p"), F.col("p"))), F.lit(1e-12))
    rows = rows.filter("p is not null").select(key, order, length.alias("first_difference"), cosine.alias("cosine"))
    return rows.withColumn("second_difference", F.col("first_difference") - F.lag("first_difference").over(w))


def second_order_summary(df: DataFrame, key: str = "label", value: str = "second_difference") -> DataFrame:
    """Count, mean, sample deviation (0 for one value), least and greatest."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"), F.min(value).alias("low"), F.max(value).alias("high"))


def order_violations(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is not greater than the one before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("before_value", before).filter(F.col(value) <= F.col("before_value"))


def round_robin(df: DataFrame, label: str, bucket: str, row: str, take: int, seed: int) -> DataFrame:
    """`take` rows of each label, one of each bucket in turn, in a seeded order within the bucket."""
    inner = Window.partitionBy(label, bucket).orderBy(F.xxhash64(F.lit(seed), row), row)
    turns = df.withColumn("turn", F.row_number().over(inner)).filter(F.col("turn") <= take)
    return turns.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("turn", bucket, row))).filter(F.col("rank") <= take)
