"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.ranks import broadcast_if_small, global_rank
from citeloom.scratch import materialize
from citeloom.shipping import bounded_batches

__all__ = ["bounded_batches", "broadcast_if_small", "global_rank", "let", "materialize", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas would compute what they mention anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
