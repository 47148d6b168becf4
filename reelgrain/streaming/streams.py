"""Structured Streaming forms of the sequence operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILE_ROWS = 500_000  # of a ledger's file


def windowed(stream: DataFrame, at: str = "ts", value: str = "value", key: str = "event_type", size: str = "1 day", hop: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sliding windows with a watermark; a window is emitted once, when it is complete."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, size, hop).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "high")
    )


def sessions(stream: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of an entity's rows without a longer gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _folded(stream: DataFrame, key: str, at: str, late: str, columns: list[str], fold: Callable, out: str, state: str, keep_seconds: float | None) -> DataFrame:
    """A fold over each key's rows in order of time, with state between batches. A key whose time lies `keep_seconds` behind the watermark is let go, if asked for."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = fold(held.get, None)[1]
            held.remove()
            if len(last):
                yield last.assign(**{key: k[0]})[names]
            return
        rows = pd.concat([p for p in parts if len(p)]).sort_values(columns)
        new, found = fold(held.get if held.exists else None, rows)
        held.update(new)
        if keep_seconds is not None:
            held.setTimeoutTimestamp(max(int((rows[at].max().timestamp() + keep_seconds) * 1000), held.getCurrentWatermarkMs() + 1))
        yield found.assign(**{key: k[0]})[names]

    names = [key, *(c.strip().split()[0] for c in out.split(","))]
    timeout = GroupStateTimeout.NoTimeout if keep_seconds is None else GroupStateTimeout.EventTimeTimeout
    rows = stream.select(key, F.col(at).cast("timestamp").alias(at), *(c for c in columns if c != at), *(c for c in ("value",) if c in stream.columns and c not in columns)).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, {out}", state, "append", timeout)


def thinned(stream: DataFrame, seconds: float, at: str = "ts", key: str = "user_id", late: str = "1 day", keep_seconds: float | None = None) -> DataFrame:
    """Greedy thinning with the last kept time as state: a row is kept if it lies `seconds` after the last kept one.

    Rows of a batch are taken in order of time. A row that comes later than rows after it were taken is kept only if it lies
    after the last kept one, as the state cannot go back. State may go `keep_seconds` after a key's last row: more than
    `seconds` changes nothing.
    """

    def fold(state, rows):
        nxt = state[0] if state else -float("inf")
        kept = []
        for t in rows[at] if rows is not None else ():
            s = t.timestamp()
            if s + 1e-9 >= nxt:
                kept.append(t)
                nxt = s + seconds
        return (nxt,), pd.DataFrame({at: pd.Series(kept, dtype="datetime64[ns]")})

    return _folded(stream, key, at, late, [at], fold, f"{at} timestamp", "next double", keep_seconds)


def flagged_runs(stream: DataFrame, limit: float, at: str = "ts", order: str = "event_id", key: str = "user_id", late: str = "1 day", keep_seconds: float = 86400.0 * 30) -> DataFrame:
    """Maximal runs of a key's rows whose value is at most `limit`: start, end and length, emitted when a run ends by another row or its key's state is let go."""

    def fold(state, rows):
        first, last, n = state if state and state[2] else (0.0, 0.0, 0)
        out = []
        if rows is None:
            return (0.0, 0.0, 0), frame([(first, last, n)] if n else [])
        for t, v in zip(rows[at], rows["value"]):
            if v <= limit:
                s = t.timestamp()
                first, last, n = (s if not n else first), s, n + 1
            elif n:
                out.append((first, last, n))
                n = 0
        return (first, last, n), frame(out)

    def frame(runs):
        return pd.DataFrame({"start_seconds": [r[0] for r in runs], "end_seconds": [r[1] for r in runs], "n": pd.Series([r[2] for r in runs], dtype="int64")})

    return _folded(stream, key, at, late, [at, order], fold, "start_seconds double, end_seconds double, n bigint", "first double, last double, n bigint", keep_seconds)


def merged(stream: DataFrame, gap: float, span: float, at: str = "ts", order: str = "event_id", key: str = "user_id", late: str = "1 day", keep_seconds: float = 86400.0 * 30) -> DataFrame:
    """Rows to groups as they come: one joins the open group if it begins within `gap` of its end and the whole stays within `span`; a group is emitted when the next begins or its key's state is let go."""

    def fold(state, rows):
        first, last, n = state if state else (0.0, 0.0, 0)
        out = []
        if rows is None:
            return (0.0, 0.0, 0), frame([(first, last, n)] if n else [])
        for t in rows[at]:
            s = t.timestamp()
            if n and s - last <= gap + 1e-9 and s - first <= span + 1e-9:
                last, n = max(last, s), n + 1
            else:
                if n:
                    out.append((first, last, n))
                first, last, n = s, s, 1
        return (first, last, n), frame(out)

    def frame(groups):
        return pd.DataFrame({"start_seconds": [g[0] for g in groups], "end_seconds": [g[1] for g in groups], "n": pd.Series([g[2] for g in groups], dtype="int64")})

    return _folded(stream, key, at, late, [at, order], fold, "start_seconds double, end_seconds double, n bigint", "first double, last double, n bigint", keep_seconds)


def guarded_times(stream: DataFrame, at: str = "ts", order: str = "event_id", key: str = "user_id", late: str = "1 day") -> DataFrame:
    """Rows in order of arrival number with a time that never falls back: the reported one, or the last one and `previous` where the report lies behind it."""

    def fold(state, rows):
        last = state[0] if state else -float("inf")
        ids, times, sources = [], [], []
        for t, i in zip(rows[at], rows[order]) if rows is not None else ():
            s = t.timestamp()
            sources.append("reported" if s >= last else "previous")
            last = max(last, s)
            ids.append(i)
            times.append(last)
        return (last,), pd.DataFrame({order: pd.Series(ids, dtype="int64"), "seconds": times, "source": sources})

    return _folded(stream, key, at, late, [order, at], fold, f"{order} bigint, seconds double, source string", "last double", None)


def distinct_arrivals(stream: DataFrame, key: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of a key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def ledger(path: str, key: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose key the ledger lacks; a replayed batch adds nothing.

    Files are in order of a hash of the key, and a batch reads the pages of them that its own keys fall into, so that a small
    batch does not read the whole. Their number follows the rows that are new: one file for each `FILE_ROWS` of a batch, and
    none where nothing is new.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        parts = [r[0] for r in fresh.select("part").distinct().collect()]  # at most `buckets`
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        if there and parts:
            held = spark.read.schema(fresh.schema).parquet(path).filter(F.col("part").isin(parts)).select(key)
            added = fresh.join(held, key, "left_anti").persist()
        else:
            added = fresh
        n = added.count()
        if n or not there:
            added.coalesce(max(1, math.ceil(n / FILE_ROWS))).sortWithinPartitions("part").write.mode("append").parquet(path)
        added.unpersist()
        fresh.unpersist()

    return write


def into_ledger(stream: DataFrame, path: str, key: str, marks: str) -> None:
    """Run a stream over what is there into a ledger."""
    stream.writeStream.foreachBatch(ledger(path, key)).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    spark = stream.sparkSession
    out, marks = f"{folder}/{name}", f"{folder}/{name}-checkpoint"
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
