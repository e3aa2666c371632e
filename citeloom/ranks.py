"""Positions in a global order without a global window, and broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.scratch import materialize

#: A table is broadcast only up to this many rows, and up to this many bytes of what they hold.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _bytes(name: str, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 32
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if ``df`` (cheap to read) has at most ``rows`` rows of ``size`` bytes in all; else ``df``."""
    held = sum((_bytes(n, k) for n, k in df.dtypes), F.lit(0)).cast("long")
    n, b = df.agg(F.count("*"), F.sum(held)).first()
    return F.broadcast(df) if n <= rows and (b or 0) <= size else df


def global_rank(df: DataFrame, keys: list[Column | str], name: str, rank: str = "_rank") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``keys``.

    Rows are dealt by sampled ranges of all keys, so that one frequent value
    does not land in one task, and written once, as ranges that are planned
    twice may differ; a table of one row for each partition then turns places
    inside partitions into places overall.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(rank, F.col("_start") + inside)
        .drop("_part", "_place", "_start")
    )
