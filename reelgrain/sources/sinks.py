"""Writers with deterministic output."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.functions.scalars import human_size, safe_name
from reelgrain.session import remove, write_small


def export_csv(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """Columns in order of name, rows in order of key, null as an empty field. Part files follow the order of key ranges."""
    df.select(*(F.col(f"`{c}`") for c in sorted(df.columns))).orderBy(f"`{key}`").write.mode(mode).csv(path, header=True, nullValue="", emptyValue="")


def export_jsonl(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """Sorted keys, nulls written, NaN and infinity as null."""
    clean = lambda c, t: F.when(~F.isnan(F.col(f"`{c}`")) & (F.abs(F.col(f"`{c}`")) != float("inf")), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
    df.select(*(clean(c, t) for c, t in sorted(df.dtypes))).orderBy(f"`{key}`").write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def artifact_records(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, size and digest of binary contents."""
    return df.select(F.col(path).alias("path"), F.length(content).alias("size_bytes"), F.sha2(F.col(content), 256).alias("sha256"))


def written_parts(spark: SparkSession, path: str) -> DataFrame:
    """path, size, human size and digest of every part file of a written table, as the receipt of an export."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), human_size(F.col("length")).alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def taken(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def output_set(spark: SparkSession, folder: str, tables: Mapping[str, tuple[DataFrame, str]] | None = None, documents: Mapping[str, object] | None = None, overwrite: bool = False) -> list[str]:
    """A folder of tables and JSON documents that belong together; the paths written.

    tables: name -> (table, format of csv, json or parquet). What exists is an error unless `overwrite`; all names are
    looked at before the first is written, so a refused set leaves nothing. A set that fails while it is written is removed
    as far as it was written by this call.
    """
    tables, documents = dict(tables or {}), dict(documents or {})
    paths = {n: f"{folder}/{n}.{kind}" for n, (_, kind) in tables.items()} | {n: f"{folder}/{n}.json" for n in documents}
    held = sorted(p for p in paths.values() if taken(spark, p))
    if held and not overwrite:
        raise FileExistsError(f"output already exists: {held}")
    done: list[str] = []
    try:
        for n, (df, kind) in tables.items():
            done.append(paths[n])
            writer = df.write.mode("overwrite" if overwrite else "errorifexists")
            if kind == "csv":
                writer.csv(paths[n], header=True, nullValue="", emptyValue="")
            elif kind == "json":
                writer.option("ignoreNullFields", "false").json(paths[n])
            else:
                writer.parquet(paths[n])
        for n, document in documents.items():
            done.append(paths[n])
            if overwrite:
                remove(spark, paths[n])
            write_small(spark, paths[n], json.dumps(document, sort_keys=True, indent=2, allow_nan=False))
    except Exception:
        for path in done:
            remove(spark, path)
        raise
    return [paths[n] for n in (*tables, *documents)]


def new_folder(spark: SparkSession, root: str, name: str) -> str:
    """A folder for one run that was not there before; a time stamp keeps runs apart."""
    import datetime

    path = f"{root}/{datetime.datetime.now(datetime.timezone.utc):%Y-%m-%d_%H%M%S}_{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target) or not store.mkdirs(target):
        raise FileExistsError(path)
    return path


def copied(spark: SparkSession, plan: DataFrame, root: str) -> DataFrame:
    """Copy each (source, label, digest, name) of a plan to root/label/digest16__name, in the tasks; source, target, size and whether it was there already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (a, pa_), (b, pb) = (fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p) for p in (source, target))
                there = b.get_file_info(pb).type != fs.FileType.NotFound
                if not there:
                    b.create_dir(pb.rpartition("/")[0], recursive=True)
                    fs.copy_files(pa_, pb, a, b)
                rows.append((source, target, b.get_file_info(pb).size, there))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["source", "target", "size_bytes", "existing"])

    target = F.concat_ws("/", F.lit(root), "label", F.concat(F.substring("digest", 1, 16), F.lit("__"), safe_name(F.col("name"))))
    return plan.select("source", target.alias("target")).mapInArrow(work, "source string, target string, size_bytes bigint, existing boolean")
