"""Detectors as plug-ins over tables: an availability gate, a registry of encoders, and a run in the tasks with a time limit.

A detector gets the rows of one entity in order and returns one row. It is built once per worker process. A failure or
overrun of one entity is a row with its status and reason and never ends the job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "entity string, status string, reason_code string, message string, score double, frames int, seconds double"


@dataclass(frozen=True)
class Availability:
    status: str
    reason_code: str | None = None
    missing: tuple[str, ...] = ()


class Detector(Protocol):
    """What a plug-in offers."""

    def check(self, settings: Mapping[str, Any]) -> Availability: ...

    def analyse(self, vectors: np.ndarray) -> float: ...


@dataclass(frozen=True)
class Encoder:
    """A named way from frames to vectors, and the packages that it needs."""

    name: str
    packages: tuple[str, ...]
    build: Callable[[], Callable[[np.ndarray], np.ndarray]]


def mean_pool(cells: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in encoder without a model: mean brightness of a grid of cells."""

    def encode(gray: np.ndarray) -> np.ndarray:
        rows, columns = np.array_split(np.arange(gray.shape[0]), cells), np.array_split(np.arange(gray.shape[1]), cells)
        return np.array([[gray[np.ix_(r, c)].mean() if len(r) and len(c) else 0.0 for c in columns] for r in rows]).ravel()

    return encode


ENCODERS: dict[str, Encoder] = {"mean_pool": Encoder("mean_pool", (), mean_pool)}
DISTANCES = ("l2", "cosine")


def available(settings: Mapping[str, Any], encoders: Mapping[str, Encoder] | None = None) -> Availability:
    """The first thing that stands against a run, in order: all off, this one off, preprocessing, encoder, distance, packages."""
    import importlib.util

    encoders = ENCODERS if encoders is None else encoders
    if not settings.get("detectors_enabled", True):
        return Availability("disabled", "global_detector_layer_disabled")
    if not settings.get("enabled", False):
        return Availability("disabled", "detector_disabled")
    if settings.get("preprocessing_mode") != "upstream_compatible":
        return Availability("unavailable", "unsupported_preprocessing_mode")
    if settings.get("encoder") not in encoders:
        return Availability("unavailable", "invalid_encoder")
    if settings.get("distance_mode") not in DISTANCES:
        return Availability("unavailable", "invalid_distance_mode")
    missing = tuple(p for p in encoders[settings["encoder"]].packages if importlib.util.find_spec(p) is None)
    return Availability("unavailable", "optional_dependencies_missing", missing) if missing else Availability("completed")


class SecondOrder:
    """Deviation of the second differences of consecutive distances between vectors."""

    def __init__(self, distance: str = "l2"):
        self.distance = distance

    def check(self, settings: Mapping[str, Any]) -> Availability:
        return available(settings)

    def analyse(self, vectors: np.ndarray) -> float:
        if len(vectors) < 3:
            raise ValueError("fewer than three frames")
        a, b = vectors[:-1], vectors[1:]
        if self.distance == "cosine":
            first = (a * b).sum(1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-12)
        else:
            first = np.linalg.norm(b - a, axis=1)
        second = np.diff(first)
        return float(second.std(ddof=1)) if len(second) > 1 else 0.0


def run(df: DataFrame, make: Callable[[], Detector], settings: Mapping[str, Any], limit_seconds: float = 300.0, key: str = "entity", order: str = "frame_index", vector: str = "vector") -> DataFrame:
    """A result row per entity of (key, order, vector) rows. The time limit is that of one entity; one that overruns is stopped where signals allow it and has the status `failed`."""
    settings = dict(settings)
    build = make

    def analyse(own: Detector, vectors: np.ndarray) -> tuple[str, str | None, str | None, float | None]:
        import signal
        import threading

        guarded = threading.current_thread() is threading.main_thread() and hasattr(signal, "setitimer")

        def stop(*_: Any) -> None:
            raise TimeoutError

        try:
            before = signal.signal(signal.SIGALRM, stop) if guarded else None
            if guarded:
                signal.setitimer(signal.ITIMER_REAL, limit_seconds)
            try:
                score = own.analyse(vectors)
            finally:
                if guarded:
                    signal.setitimer(signal.ITIMER_REAL, 0)
                    signal.signal(signal.SIGALRM, before)
            return ("completed", None, None, score) if np.isfinite(score) else ("failed", "score_not_finite", None, None)
        except TimeoutError:
            return "failed", "worker_timeout", None, None
        except Exception as x:
            return "failed", "analysis_failed", " ".join(str(x).split())[:500], None

    def one(entity: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own, began = build(), time.perf_counter()
        gate = own.check(settings)
        result = analyse(own, np.array(part.sort_values(order)[vector].tolist(), float)) if gate.status == "completed" else (gate.status, gate.reason_code, json.dumps(gate.missing) if gate.missing else None, None)
        return pd.DataFrame([(entity[0], *result, len(part), round(time.perf_counter() - began, 6))], columns=[c.split()[0] for c in RESULT.split(", ")])

    return df.select(F.col(key).cast("string").alias("entity"), order, vector).groupBy("entity").applyInPandas(one, RESULT)


def encoded_frames(frames: DataFrame, encoder: str = "mean_pool", encoders: Mapping[str, Encoder] | None = None) -> DataFrame:
    """entity, frame_index, vector of gray frames (entity, frame_index, raw, width, height); the encoder is built once per task."""
    chosen = (ENCODERS if encoders is None else encoders)[encoder]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chosen.build()
        for batch in batches:
            vectors = [encode(np.frombuffer(raw, np.uint8).reshape(h, w).astype(float)).tolist() for raw, w, h in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float64()))], names=["entity", "frame_index", "vector"])

    return frames.select(F.col("entity").cast("string").alias("entity"), F.col("frame_index").cast("int").alias("frame_index"), "raw", "width", "height").mapInArrow(work, "entity string, frame_index int, vector array<double>")


def prepared(gray: np.ndarray, size: int = 224, trim: float = 0.10, mean: Sequence[float] = (0.485, 0.456, 0.406), deviation: Sequence[float] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """A frame (height x width x 3, 0 to 255) as an encoder takes it: the longer side trimmed at both ends, resized bilinearly, scaled and normalised, channels first."""
    image = np.asarray(gray, float)
    h, w = image.shape[:2]
    cut = int(max(h, w) * trim)
    image = image[cut : h - cut] if h > w else image[:, cut : w - cut] if w > h else image
    h, w = image.shape[:2]
    at = lambda n: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    mixed = (image[y0][:, x0] * (1 - fy) + image[y1][:, x0] * fy) * (1 - fx) + (image[y0][:, x1] * (1 - fy) + image[y1][:, x1] * fy) * fx
    return ((mixed / 255 - np.array(mean)) / np.array(deviation)).transpose(2, 0, 1)
