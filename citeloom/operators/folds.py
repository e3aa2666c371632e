"""Changes of served tables as folds over operation logs and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.medallion import SERVED
from citeloom.ranks import broadcast_if_small, global_rank
from citeloom.schemas import PROGRESS_STATES
from citeloom.scratch import materialize

#: What a sync overwrites.
PAPER_FIELDS = [c for c in SERVED if c != "work_id"]


def upsert_papers(current: DataFrame, incoming: DataFrame, now: Column, prune: bool = False) -> DataFrame:
    """Incoming works overwrite; a changed abstract voids the embedding mark; works that are not sent stay.

    ``prune`` drops the latter instead. ``incoming`` has one row a work.
    """
    c = current.select(*[F.col(x).alias(f"_{x}") for x in ("work_id", *PAPER_FIELDS, "synced_at", "embedded_at")])
    n = incoming.select("work_id", *PAPER_FIELDS)
    both = c.join(n, c["_work_id"] == n["work_id"], "right" if prune else "full_outer")
    sent = F.col("work_id").isNotNull()
    changed = ~F.col("narrative_abstract").eqNullSafe(F.col("_narrative_abstract"))
    return both.select(
        F.coalesce("work_id", "_work_id").alias("work_id"),
        *[F.when(sent, F.col(x)).otherwise(F.col(f"_{x}")).alias(x) for x in PAPER_FIELDS],
        F.when(sent, now).otherwise(F.col("_synced_at")).alias("synced_at"),
        F.when(sent & changed, F.lit(None)).otherwise(F.col("_embedded_at")).alias("embedded_at"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace those with the same keys; others stay."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming.select(*current.columns))


def add_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are new are added; nothing changes or goes."""
    fresh = incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def fold_progress(log: DataFrame) -> DataFrame:
    """Reading progress from a log (seq, user_id, work_id, status, ts).

    The last status counts; started_at is the first start; completed_at is
    that of the last event and empty unless it says completed. A status that
    is none of PROGRESS_STATES comes out null. One hash aggregation that
    combines before the shuffle.
    """
    states = F.array(*[F.lit(x) for x in PROGRESS_STATES])
    code = F.array_position(states, F.col("status")).cast("int")  # a number, so that the aggregation can hash
    done = F.when(F.col("status") == "completed", F.col("ts"))
    began = F.col("status") == "in_progress"
    folded = log.groupBy("user_id", "work_id").agg(
        F.max_by(code, "seq").alias("_code"),
        F.min_by(F.when(began, F.col("ts")), F.when(began, F.col("seq"))).alias("started_at"),
        F.max_by(done, "seq").alias("completed_at"),
        F.max("ts").alias("updated_at"),
    )
    return folded.select("user_id", "work_id", F.try_element_at(states, F.nullif(F.col("_code"), F.lit(0))).alias("status"), "started_at", "completed_at", "updated_at")


def fold_membership(log: DataFrame) -> DataFrame:
    """Collection members from a log (seq, op: add or remove, collection_id, work_id, ts).

    Adding what is there keeps the first time; removing and adding again
    starts anew. One aggregation, combined before the shuffle, tells the time
    of all members but those that were there before their last removal and
    came back after it; only their rows are looked at again, and they are
    joined to the log without a shuffle of it while they are few.
    """
    keys = ["collection_id", "work_id"]
    added = F.when(F.col("op") == "add", F.col("seq"))
    ends = materialize(
        log.where("op IN ('add', 'remove')").groupBy(*keys).agg(
            F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("_gone"),
            F.min(added).alias("_first"),
            F.max(added).alias("_last"),
            F.min_by("ts", added).alias("added_at"),
        ).where("_last IS NOT NULL AND (_gone IS NULL OR _last > _gone)"),
        "membership",
    )
    back = "_gone IS NOT NULL AND _first <= _gone"
    again = broadcast_if_small(ends.where(back).select(*[F.col(k).alias(f"_{k}") for k in keys], "_gone"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    since = log.where("op = 'add'").join(again, [*same, F.col("seq") > F.col("_gone")]).groupBy(*keys).agg(F.min_by("ts", "seq").alias("added_at"))
    return ends.where(f"NOT ({back})").select(*keys, "added_at").unionByName(since)


def keep_first(log: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: the first row of a log (seq, ...) for each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")


def with_ids(log: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Numbers the rows of a log (seq, ...) from ``start`` in log order, without a global window.

    The ranged rows are written once: planned twice, their ranges would differ.
    """
    return global_rank(log, ["seq"], "ids", name).withColumn(name, F.col(name) + start)


def save_plan(members: DataFrame, path: DataFrame) -> DataFrame:
    """Members with sequence_rank from a reading path; members without an entry keep theirs."""
    ranks = path.select("collection_id", "work_id", F.col("rank").alias("_rank"))
    return members.join(ranks, ["collection_id", "work_id"], "left").withColumn("sequence_rank", F.coalesce("_rank", "sequence_rank")).drop("_rank").select(*members.columns)


def cascade(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose parent is still there."""
    return child.join(parent.select(key), key, "left_semi").select(*child.columns)


def set_null(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """``child`` with the key emptied where the parent is gone."""
    there = parent.select(F.col(key).alias("_k"), F.lit(True).alias("_there")).distinct()
    return child.join(there, F.col(key) == F.col("_k"), "left").withColumn(key, F.when(F.col("_there"), F.col(key))).select(*child.columns)


def replace_by_key(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by its rows."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*current.columns))
