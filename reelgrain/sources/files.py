"""Readers of the file formats in use: media listings, feature exports, manifests, sniffed CSV, probe documents, PCM audio."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.functions import scalars as sc
from reelgrain.operators.audit import present_text

MEDIA = ("mp4", "mov", "mkv", "avi", "webm", "m4v")


def media_files(spark: SparkSession, folder: str, extensions: Sequence[str] = MEDIA, recursive: bool = False) -> DataFrame:
    """path, name, suffix, size, human size of media files. The content column is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    rows = files.select("path", sc.base_name(F.col("path")).alias("name"), sc.suffix(F.col("path")).alias("suffix"), F.col("length").alias("size_bytes"), sc.human_size(F.col("length")).alias("size"))
    return rows.filter(F.col("suffix").isin(*(f".{e}" for e in extensions)))


def content_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path and SHA-256 of each file up to 2 GiB."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def streamed_digests(spark: SparkSession, folder: str, chunk: int = 1 << 20) -> DataFrame:
    """path and SHA-256 of each file, read a chunk at a time in the tasks: of any size, and none is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                uri = f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
                store, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while data := f.read(chunk):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "sha256"])

    return spark.read.format("binaryFile").load(folder).select("path").mapInArrow(run, "path string, sha256 string")


def head_of(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """The first bytes of a file, or of the first file with content in a folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(target):
        raise FileNotFoundError(path)
    parts = sorted((f for f in store.listStatus(target) if f.isFile() and f.getLen() > 0 and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().getName())
    if not parts:
        return b""
    held = store.open(parts[0].getPath())
    try:
        return bytes(held.readNBytes(size))
    finally:
        held.close()


def resolved(spark: SparkSession, path: str | None, usual: Sequence[str]) -> str:
    """The path that is asked for, else the first of the usual ones that is there."""
    from reelgrain.sources.sinks import taken

    for candidate in [path] if path else usual:
        if taken(spark, candidate):
            return candidate
    raise FileNotFoundError(path or f"none of {list(usual)}")


def sniffed(head: str) -> str:
    """The delimiter of a CSV head among , ; tab and |, a comma if none stands out."""
    try:
        return csv.Sniffer().sniff(head[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def feature_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV export, all columns as text, texts that mean missing as null; quoted fields may hold line breaks; rows of another width are an error.

    The delimiter and the encoding (UTF-8, else Latin-1) are told from the first 4,096 bytes; what is not UTF-8 only later
    on must be named.
    """
    head = head_of(spark, path)
    if not head.strip():
        raise ValueError(f"{path} is empty")
    if encoding is None:
        try:
            head[: max(1, len(head) - 3)].decode("utf-8") if len(head) == 4096 else head.decode("utf-8")
            encoding = "UTF-8"
        except UnicodeDecodeError as x:
            encoding = "UTF-8" if x.start > len(head) - 8 and len(head) == 4096 else "ISO-8859-1"
    if delimiter is None:
        delimiter = sniffed(head.decode("utf-8" if encoding == "UTF-8" else "latin-1", "replace"))
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", sep=delimiter, encoding=encoding, escape='"', multiLine=True)
    return raw.select(*(present_text(F.col(f"`{c}`")).alias(c.lstrip("\ufeff")) for c in raw.columns))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON object each, over many lines; anything else is an error."""
    head = head_of(spark, path).decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    if not head.startswith("{"):
        raise ValueError(f"{path} holds no object")
    return spark.read.json(path, multiLine=True, mode="FAILFAST")


def probe_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, body, error of stored probe documents: a file that is no JSON object has the error that a failed probe has."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    fits = F.try_parse_json("body").isNotNull() & F.startswith(F.ltrim("body"), F.lit("{"))
    return rows.select("path", F.when(fits, F.col("body")).alias("body"), F.when(~F.coalesce(fits, F.lit(False)), "probe_failed").alias("error"))


def feature_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL export; the union of all fields, absent ones null. A malformed line is an error."""
    return spark.read.json(path, mode="FAILFAST", dropFieldIfAllNull=False)


def manifest_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(entries, lines that are no entry with their text)."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    text = spark.read.text(path)
    bad = text.filter(F.btrim("value") != "").filter(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())
    return rows.filter("_bad is null").drop("_bad"), bad.select(F.col("value").alias("line"))


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV, JSONL / JSON or Parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return feature_csv(spark, path)
    if kind in ("jsonl", "json", "ndjson"):
        return feature_jsonl(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


PROBE = (
    "format struct<duration: string, format_name: string, bit_rate: string, tags: map<string,string>>, "
    "streams array<struct<codec_type: string, codec_name: string, index: int, start_time: string, duration: string, avg_frame_rate: string, r_frame_rate: string, nb_frames: string, width: int, height: int, disposition: map<string,int>, tags: map<string,string>>>"
)


def probe_metadata(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Normalised container, video and audio facts of probe documents. The default stream, else the first; attached pictures are no video."""
    p = F.from_json(F.col(body), PROBE)
    rows = documents.select(key, p.alias("p"))
    streams = F.coalesce(F.col("p.streams"), F.array())
    flag = lambda s, name: F.coalesce(F.try_element_at(s["disposition"], F.lit(name)), F.lit(0)) == 1
    video = F.filter(streams, lambda s: (s["codec_type"] == "video") & ~flag(s, "attached_pic"))
    audio = F.filter(streams, lambda s: s["codec_type"] == "audio")
    pick = lambda found: F.coalesce(F.get(F.filter(found, lambda s: flag(s, "default")), F.lit(0)), F.get(found, F.lit(0)))
    v, a = F.col("v"), F.col("a")
    rate = F.coalesce(sc.frame_rate(v["avg_frame_rate"]), sc.frame_rate(v["r_frame_rate"]))
    duration = F.coalesce(sc.number(v["duration"]), sc.number(F.col("p.format.duration")))
    turned = sc.rotation(F.coalesce(sc.whole_number(F.try_element_at(v["tags"], F.lit("rotate"))), F.lit(0)))
    side = turned.isin(90, 270)
    return rows.select(key, "p", pick(video).alias("v"), pick(audio).alias("a")).select(
        key, v["index"].alias("video_index"), v["codec_name"].alias("video_codec"), F.round(duration, 6).alias("duration_seconds"), F.round(rate, 6).alias("frame_rate"), sc.unusual_rate(rate).alias("unusual_rate"),
        F.coalesce(sc.whole_number(v["nb_frames"]), F.round(duration * rate).cast("bigint")).alias("frame_count"), turned.alias("rotation"),
        F.when(side, v["height"]).otherwise(v["width"]).alias("display_width"), F.when(side, v["width"]).otherwise(v["height"]).alias("display_height"),
        a.isNotNull().alias("audio_present"), a["index"].alias("audio_index"), F.abs(sc.number(a["duration"]) - sc.number(v["duration"])).alias("duration_difference"),
    )


def pcm_samples(spark: SparkSession, folder: str) -> DataFrame:
    """path, channel, sample_index, amplitude of 16-bit WAV files; a trailing part of a frame is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import wave

        import numpy as np

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with wave.open(io.BytesIO(content.as_py())) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{path} is not 16-bit PCM")
                    channels, raw = w.getnchannels(), w.readframes(w.getnframes())
                amp = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").astype(np.float64).reshape(-1, channels) / 32768
                for c in range(channels):
                    for lo in range(0, len(amp), 100_000):
                        part = amp[lo : lo + 100_000, c]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.full(len(part), c, np.int32)), pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["path", "channel", "sample_index", "amplitude"])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, "path string, channel int, sample_index bigint, amplitude double")
