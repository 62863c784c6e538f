"""A session with the settings that the operators are meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "palimpsest", **settings: str) -> SparkSession:
    """Adaptive execution, UTC, zstd shuffles; anything in settings (dots as double underscores) wins."""
    chosen = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.io.compression.codec": "zstd",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=chosen).getOrCreate()
