"""Session helpers: table loading, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("reelgrain")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one when it is unset (one machine)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="reelgrain-")
        sc.setCheckpointDir(_LOCAL[key])
        atexit.register(_remove_local, _LOCAL[key][7:])
    return _LOCAL[key]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/reelgrain/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove everything that this application wrote to the shared folder. Results that have not been taken yet are lost with it."""
    remove(spark, f"{shared_dir(spark)}/reelgrain/{spark.sparkContext.applicationId}")


def store(df: DataFrame, path: str, partition_by: str | None = None, **options: str) -> None:
    """Write a table; its shuffle files go as soon as it is there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    writer = df.write.options(**{"compression": "zstd", **options})
    spark.conf.set(key, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str = "step", partition_by: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Cut lineage through a table in the shared folder, which outlives any executor. Its path is added to `paths`, for `remove`."""
    spark = df.sparkSession
    path = scratch(spark, label)
    store(df, path, partition_by)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a metadata table in the driver; more than `most` are an error and never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a metadata table has more than {most} rows")
    return rows


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """The full addresses of a folder's parquet files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    names = [i.getPath().toUri().toString() for i in found]
    return [f"file://{n[5:]}" if n.startswith("file:/") and not n.startswith("file://") else n for n in names if n.endswith(".parquet")]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so any shared store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A new small file through Hadoop's file system; it fails where the file exists."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, folder: str) -> dict[str, str]:
    """The texts of the small files in a folder, by name; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for info in store.listStatus(target) if store.exists(target) else []:
        held = store.open(info.getPath())
        found[info.getPath().getName()] = bytes(held.readAllBytes()).decode()
        held.close()
    return found


def tail_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
