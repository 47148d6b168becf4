"""All queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelgrain.plans import checks, datasets, evidence, general, governance, sequences, streams, timelines

MODULES = (general, datasets, governance, sequences, evidence, timelines, checks, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
