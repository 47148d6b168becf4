"""Kernels over pixels and samples: numpy on Arrow batches where an expression cannot say it, aggregates where it can."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FRAME = T.StructType([T.StructField(n, t) for n, t in (("brightness_mean", T.DoubleType()), ("contrast_stddev", T.DoubleType()), ("laplacian_variance", T.DoubleType()), ("dark_pixel_ratio", T.DoubleType()), ("bright_pixel_ratio", T.DoubleType()), ("perceptual_hash", T.StringType()))])


def _perceptual_hash(gray: np.ndarray) -> str:
    """64 bits: the low frequencies of a 32 x 32 cosine transform against their median."""
    h, w = gray.shape
    small = gray[np.arange(32) * h // 32][:, np.arange(32) * w // 32].astype(float)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    return f"{int(''.join('1' if x else '0' for x in (low > np.median(low)).ravel()), 2):016x}"


def _frame(raw: bytes, width: int, height: int) -> tuple:
    g = np.frombuffer(raw, np.uint8).reshape(height, width)
    f = g.astype(float)
    inner = f[1:-1, 1:-1]
    edge = f[:-2, 1:-1] + f[2:, 1:-1] + f[1:-1, :-2] + f[1:-1, 2:] - 4 * inner
    return f.mean(), f.std(), float(edge.var()) if edge.size else 0.0, float((g < 16).mean()), float((g > 240).mean()), _perceptual_hash(g)


@F.pandas_udf(FRAME)
def frame_metrics(raw: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Brightness, contrast, sharpness, dark and bright shares and perceptual hash of gray frames."""
    return pd.DataFrame([_frame(r, int(w), int(h)) for r, w, h in zip(raw, width, height)], columns=FRAME.names)


@F.pandas_udf(T.DoubleType())
def histogram_correlation(a: pd.Series, b: pd.Series) -> pd.Series:
    """Correlation of two frames' 64-bin histograms."""

    def one(x: bytes, y: bytes) -> float:
        p, q = (np.histogram(np.frombuffer(z, np.uint8), 64, (0, 256))[0].astype(float) for z in (x, y))
        p, q = p - p.mean(), q - q.mean()
        d = np.sqrt((p * p).sum() * (q * q).sum())
        return float((p * q).sum() / d) if d else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


PAIR = T.StructType([T.StructField("mean_absolute_difference", T.DoubleType()), T.StructField("histogram_correlation", T.DoubleType()), T.StructField("brightness_difference", T.DoubleType()), T.StructField("hash_distance", T.IntegerType())])


@F.pandas_udf(PAIR)
def pair_metrics(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Of two gray frames of one size: mean difference as a share of 255, correlation of 64-bin histograms, difference of brightness, differing bits of the perceptual hashes."""
    rows = []
    for x, y, w, h in zip(a, b, width, height):
        p, q = (np.frombuffer(z, np.uint8).reshape(int(h), int(w)) for z in (x, y))
        rows.append((float(np.abs(p.astype(float) - q).mean() / 255), _correlation(p, q, 64), float(abs(p.mean() - q.mean())), (int(_perceptual_hash(p), 16) ^ int(_perceptual_hash(q), 16)).bit_count()))
    return pd.DataFrame(rows, columns=PAIR.names)


def _correlation(p: np.ndarray, q: np.ndarray, bins: int) -> float:
    a, b = (np.histogram(z, bins, (0, 256))[0].astype(float) for z in (p, q))
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / d) if d else 1.0


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("red", "green", "blue")]))
def mean_colour(raw: pd.Series) -> pd.DataFrame:
    """Mean of each channel of frames of interleaved red, green and blue bytes."""
    means = [np.frombuffer(r, np.uint8).reshape(-1, 3).mean(axis=0) if r else (None,) * 3 for r in raw]
    return pd.DataFrame(means, columns=["red", "green", "blue"])


REGION = "entity bigint, from_index int, to_index int, region_id string, brightness_difference double, edge_instability double, texture_distance double, variance_difference double, gradient_difference double, detail_residual double"


def _region(p: np.ndarray, q: np.ndarray) -> tuple:
    p, q = p.astype(float), q.astype(float)

    def gradient(z: np.ndarray) -> np.ndarray:
        gy, gx = np.gradient(z) if min(z.shape) > 1 else (np.zeros_like(z), np.zeros_like(z))
        return np.hypot(gx, gy)

    def detail(z: np.ndarray) -> np.ndarray:
        e = np.pad(z, 1, mode="edge")
        return e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * z

    g, h = gradient(p), gradient(q)
    edges = [z > max(16.0, z.mean() + z.std()) for z in (g, h)]
    union = (edges[0] | edges[1]).sum()
    overlap = (edges[0] & edges[1]).sum() / union if union else 1.0
    return abs(p.mean() - q.mean()) / 255, float(1 - overlap), (1 - _correlation(p, q, 16)) / 2, abs(p.var() - q.var()) / 255**2, abs(g.mean() - h.mean()) / 255, float(np.abs(detail(p) - detail(q)).mean() / (4 * 255))


def region_metrics(pairs: DataFrame, rows: int = 4, columns: int = 4) -> DataFrame:
    """A row per region of each pair (entity, from_index, to_index, before, after, width, height) of gray frames: shares in [0, 1]. Edges are strong gradients; their instability is one less the overlap over the union."""

    def run(batches):
        for batch in batches:
            out = []
            for e, i, j, a, b, w, h in zip(*(batch.column(k).to_pylist() for k in range(7))):
                p, q = (np.frombuffer(z, np.uint8).reshape(h, w) for z in (a, b))
                for r in range(rows):
                    for c in range(columns):
                        part = np.s_[r * h // rows : (r + 1) * h // rows, c * w // columns : (c + 1) * w // columns]
                        if p[part].size:
                            out.append((e, i, j, f"region-r{r:02d}-c{c:02d}", *map(float, _region(p[part], q[part]))))
            names = [x.split()[0] for x in REGION.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 10, types)], names=names)

    named = ["entity", "from_index", "to_index", "before", "after", "width", "height"]
    return pairs.select(F.col("entity").cast("bigint"), *(F.col(c).cast("int") for c in named[1:3]), *named[3:]).mapInArrow(run, REGION)


def classified_regions(regions: DataFrame, edge: float = 0.35, texture: float = 0.30, detail: float = 0.16, brightness: float = 0.12) -> DataFrame:
    """Regions with whether they vary and by which rules, in order of rule."""
    rules = {"edge_instability": F.col("edge_instability") >= edge, "texture_distance": F.col("texture_distance") >= texture, "detail_residual": F.col("detail_residual") >= detail, "brightness_difference": F.col("brightness_difference") >= brightness}
    fired = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))
    return regions.withColumn("triggered_rules", fired).withColumn("varies", F.size("triggered_rules") > 0)


@F.pandas_udf(T.DoubleType())
def spectral_centroid(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Magnitude-weighted mean frequency; null for silence."""

    def one(x: np.ndarray, r: float) -> float | None:
        m = np.abs(np.fft.rfft(np.asarray(x, float)))
        return float((m * np.fft.rfftfreq(len(x), 1 / r)).sum() / m.sum()) if m.sum() > 0 else None

    return pd.Series([one(x, r) for x, r in zip(samples, rate)])


def audio_metrics(samples: DataFrame, key: str = "path", silence: float = 0.01, clip: float = 0.999) -> DataFrame:
    """Global metrics of (key, channel, sample_index, amplitude): over all channels; silence and zero crossings over their mean; level and peak of each channel and how far levels lie apart."""
    x = F.col("amplitude")
    all_ = samples.groupBy(key).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"), F.avg(x).alias("mean"), F.avg((F.abs(x) >= clip).cast("double")).alias("clipping_ratio"))
    mean = samples.groupBy(key, "sample_index").agg(F.avg(x).alias("m"))
    crossed = (F.col("m") < 0) != F.lag(F.col("m") < 0).over(Window.partitionBy(key).orderBy("sample_index"))
    mono = mean.withColumn("c", crossed).groupBy(key).agg(F.avg((F.abs("m") <= silence).cast("double")).alias("silence_ratio"), F.coalesce(F.avg(F.col("c").cast("double")), F.lit(0.0)).alias("zero_crossing_rate"))
    channels = samples.groupBy(key, "channel").agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"))
    sides = channels.groupBy(key).agg((F.max("rms") - F.min("rms")).alias("channel_imbalance"), F.array_sort(F.collect_list(F.struct("channel", "rms", "peak"))).alias("channels"))
    return all_.join(mono, key).join(sides, key)


def grid(rows: int = 4, columns: int = 4):
    """An array of normalised regions, for explode: no join is needed to cross it with transitions."""
    cell = lambda r, c: F.struct(F.lit(f"region-r{r:02d}-c{c:02d}").alias("region_id"), F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(c / columns).alias("bound_x"), F.lit(r / rows).alias("bound_y"), F.lit(1 / columns).alias("bound_width"), F.lit(1 / rows).alias("bound_height"))
    return F.array(*(cell(r, c) for r in range(rows) for c in range(columns)))


def across_grid(transitions: DataFrame, rows: int = 4, columns: int = 4) -> DataFrame:
    return transitions.select("*", F.inline(grid(rows, columns)))


def regional_summary(regions: DataFrame, key: str, metrics: tuple[str, ...]) -> DataFrame:
    """Count, mean and greatest of each metric over a transition's regions, and how far the greatest stands out."""
    out = []
    for m in metrics:
        mean = F.round(F.avg(m), 6)
        out += [mean.alias(f"mean_{m}"), F.max(m).alias(f"max_{m}"), (F.max(m) - mean).alias(f"concentration_{m}")]
    return regions.groupBy(key).agg(F.count(F.lit(1)).alias("regions"), *out)
