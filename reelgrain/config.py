"""Settings of the operators, from defaults and environment variables, and what a run was made with."""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def flag(text: str | None, default: bool) -> bool:
    """A flag as written; anything else is the default."""
    low = (text or "").strip().lower()
    return True if low in TRUE else False if low in FALSE else default


def whole(text: str | None, default: int, positive: bool = False) -> int:
    """An integer as written, above 0 if asked for; anything else is the default."""
    try:
        value = int((text or "").strip())
    except ValueError:
        return default
    return default if positive and value <= 0 else value


def number(text: str | None, default: float) -> float:
    try:
        value = float((text or "").strip())
    except ValueError:
        return default
    return value if value == value and abs(value) != float("inf") else default


def env_file(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and quotes around a value fall away."""
    found = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and name.strip() and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return found


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators. Each is overridden by REELGRAIN_ and its name in capitals."""

    analysis_rate: float = 5.0
    most_samples: int = 1500
    frame_width: int = 320
    scene_difference: float = 0.20
    scene_correlation: float = 0.80
    scene_hash_distance: int = 18
    still_difference: float = 0.01
    still_hash_distance: int = 2
    still_seconds: float = 0.6
    window_seconds: float = 0.5
    hop_seconds: float = 0.25
    silence_amplitude: float = 0.01
    silence_seconds: float = 0.5
    grid_rows: int = 4
    grid_columns: int = 4
    merge_gap_seconds: float = 0.25
    event_span_seconds: float = 1.25
    shown_events: int = 10
    shown_findings: int = 8
    shown_artifacts: int = 4
    compact_enabled: bool = True
    compact_events: int = 5
    compact_preferred_bytes: int = 8000
    compact_hard_bytes: int = 16000
    missing_share: float = 0.40
    near_constant: float = 0.95
    correlation: float = 0.95

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, prefix: str = "REELGRAIN_") -> Settings:
        """Defaults with what the environment says; counts and sizes must be positive."""
        env = os.environ if env is None else env
        out = cls()
        for f in fields(cls):
            text, default = env.get(prefix + f.name.upper()), getattr(out, f.name)
            if text is not None:
                value = flag(text, default) if isinstance(default, bool) else whole(text, default, True) if isinstance(default, int) else number(text, default)
                out = replace(out, **{f.name: value})
        return out

    def document(self) -> str:
        """The settings as canonical JSON, to be kept with what they made."""
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))


def environment(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> DataFrame:
    """name, version of the platform and packages of the driver; a package that is not there has no version."""
    from importlib.metadata import PackageNotFoundError, version

    def known(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    rows = [("spark", spark.version), ("python", platform.python_version()), ("system", platform.system()), *((p, known(p)) for p in packages)]
    return spark.createDataFrame(rows, "name string, version string")
