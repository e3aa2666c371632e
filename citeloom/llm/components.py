"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize

MAX_ROUNDS = 60
#: Edges of a round go to files of about this many rows, so that a few edges do not make many files.
FILE_ROWS = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is its smallest node.

    Alternating large-star and small-star rounds: each keeps the number of
    edges from growing and ends with a star around the smallest node. Minima
    are aggregated before they are joined, so no node's neighbours meet in one
    group. Every round is a written table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "cc")
    seen = _digest(e)
    for _ in range(MAX_ROUNDS):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        files = seen[0] // FILE_ROWS + 1  # no round has more edges than the one before
        e = materialize(rest.union(low.select("a", F.col("m").alias("b"))).distinct().coalesce(files), "cc")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).coalesce(seen[0] // FILE_ROWS + 1)


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
