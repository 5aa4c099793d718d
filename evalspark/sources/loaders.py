"""Custom source protocol (U06): ``fetch(spec) -> DataFrame`` readers registered by name.

A loader is a plain function ``(spark, spec_row: dict) -> DataFrame`` returning the
feature columns plus ``target``; the registry dispatches on the spec's ``source`` field.
Loaders read with Spark, so a registered source scales like any other scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

Loader = Callable[[SparkSession, dict], DataFrame]
LOADERS: dict[str, Loader] = {}


def register_loader(source: str):
    """Decorator: register a loader for ``source``; duplicate names are refused."""
    def deco(fn: Loader) -> Loader:
        if source in LOADERS:
            raise ValueError(f"loader {source!r} already registered")
        LOADERS[source] = fn
        return fn
    return deco


def fetch(spark: SparkSession, spec: dict) -> DataFrame:
    """Load a registry entry with the loader of its ``source``; error when unknown."""
    src = spec.get("source")
    if src not in LOADERS:
        raise ValueError(f"unknown source {src!r}; registered: {sorted(LOADERS)}")
    df = LOADERS[src](spark, spec)
    if "target" not in df.columns:
        raise ValueError(f"loader {src!r} returned no 'target' column")
    return df


@register_loader("local")
def _local(spark: SparkSession, spec: dict) -> DataFrame:
    """A table file (csv / tsv / parquet) with the curated target column renamed ``target``."""
    df = read_table(spark, spec["data_file"])
    t = spec["target"]
    if t not in df.columns:
        raise ValueError(f"target column {t!r} not in {spec['data_file']}")
    return df.select(*[c for c in df.columns if c != t], F.col(t).alias("target"))
