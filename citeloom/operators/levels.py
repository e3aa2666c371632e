"""Levels of a citation graph of any size, by peeling it round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.ranks import broadcast_if_small
from citeloom.scratch import drop_scratch, materialize


def work_levels(works: DataFrame, edges: DataFrame) -> DataFrame:
    """(work_id, level, in_citation_cycle) for every work of ``works`` (work_id).

    ``edges`` (citing_work_id, cited_work_id) may repeat; those with an end
    outside ``works`` do not count. A work without prerequisites has level 0,
    others one more than the highest of their prerequisites. Works that cite
    themselves, are on a cycle or depend on one never become free: they have
    no level, and the flag that a reading path gives them.

    Each round takes the works that are free and the edges to them away, so
    edges shrink, and no row or task holds more than an edge; there are as
    many rounds as levels. What a round wrote is removed once the next is there.
    """
    ids = works.select("work_id").where("work_id IS NOT NULL").distinct()
    inside = edges.select("citing_work_id", "cited_work_id").distinct()
    for end in ("citing_work_id", "cited_work_id"):
        inside = inside.join(ids.withColumnRenamed("work_id", end), end, "left_semi")
    inside = materialize(inside.select("citing_work_id", "cited_work_id"), "edges-left")
    citing = lambda e: e.select(F.col("citing_work_id").alias("work_id")).distinct()
    waiting = materialize(citing(inside), "works-waiting")
    free = materialize(ids.join(broadcast_if_small(waiting), "work_id", "left_anti"), "works-free")
    found, level = free.withColumn("level", F.lit(0)), 0
    while free.limit(1).count():
        level += 1
        gone = broadcast_if_small(free.withColumnRenamed("work_id", "cited_work_id"))
        left = materialize(inside.join(gone, "cited_work_id", "left_anti").select("citing_work_id", "cited_work_id"), "edges-left")
        still = materialize(citing(left), "works-waiting")
        free = materialize(waiting.join(broadcast_if_small(still), "work_id", "left_anti"), "works-free")
        found = found.unionByName(free.withColumn("level", F.lit(level)))
        drop_scratch(works.sparkSession, *_folders(inside), *_folders(waiting))
        inside, waiting = left, still
    blocked = waiting.select("work_id", F.lit(None).cast("int").alias("level"))
    return found.unionByName(blocked).select("work_id", "level", F.col("level").isNull().alias("in_citation_cycle"))


def _folders(df: DataFrame) -> set[str]:
    """The folders of a table that ``materialize`` wrote."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}
