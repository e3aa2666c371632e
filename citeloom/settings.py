"""Paths and parameters from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "citeloom."


@dataclass(frozen=True)
class Settings:
    harvest_path: str = "raw/harvest"
    topics_path: str = "raw/topics"
    bronze_path: str = "bronze"
    progress_path: str = "progress"
    per_topic: int = 200
    chunk_size: int = 1500
    chunk_overlap: int = 100

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Each field from ``citeloom.<field>`` where it is set."""
        own = cls()
        said = {f.name: spark.conf.get(PREFIX + f.name, str(getattr(own, f.name))) for f in fields(cls)}
        return cls(**{k: type(getattr(own, k))(v) for k, v in said.items()})
