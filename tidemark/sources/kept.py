"""Tables that queries share: derived once from their input files, then read, as a load job would leave them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from tidemark.sources import files

_MADE: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, name: str, path: str, build: Callable[[], str]) -> str:
    """What ``build`` returned (a folder or table name) for this input in this session; a changed input is built anew."""
    key = spark.sparkContext.applicationId, name, files.signature(spark, path)
    if key not in _MADE:
        _MADE[key] = build()
    return _MADE[key]
