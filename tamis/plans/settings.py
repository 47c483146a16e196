"""A search's settings, from one JSON document."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Neutral defaults; every list is a parameter."""

    titles: tuple[str, ...] = ()
    required_keywords: tuple[str, ...] = ()
    excluded_title_keywords: tuple[str, ...] = ()
    blocked_companies: tuple[str, ...] = ()
    language: str = "en"
    experience_min: int = 0
    experience_max: int = 99
    minimum_salary: float = 0.0
    max_results: int = 20
    max_age_hours: int = 168
    seen_ttl_hours: int = 48


def load_settings(spark: SparkSession, path: str) -> Settings:
    """One JSON document anywhere that Spark reads; keys that aren't known are left out."""
    row = spark.read.option("multiLine", True).json(path).first()
    known = {f.name for f in fields(Settings)}
    got = {k: v for k, v in row.asDict().items() if k in known and v is not None}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})
