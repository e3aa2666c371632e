"""From gold tables to served tables: keyed merges, versioned snapshots, batched external sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.fixed import SEND_ROWS
from citeloom.functions.vectors import vector_literal
from citeloom.operators.folds import add_missing, upsert, upsert_papers
from citeloom.shipping import ship_package

#: Parents before children.
ORDER = ("papers", "authors", "paper_authors", "citation_edges")
KEYS = {"authors": ["author_id"], "paper_authors": ["work_id", "author_id"], "citation_edges": ["citing_work_id", "cited_work_id"]}


def sync(current: dict[str, DataFrame], gold: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """The served tables after a sync. Papers, authors and the bridge are overwritten by key, edges only added; nothing goes."""
    out = {"papers": upsert_papers(current["papers"], gold["papers"], now)}
    for name in ("authors", "paper_authors"):
        out[name] = upsert(current[name], gold[name], KEYS[name])
    out["citation_edges"] = add_missing(current["citation_edges"], gold["citation_edges"], KEYS["citation_edges"])
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) in parent order, as one job."""
    out = None
    for name in ORDER:
        one = tables[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def write_version(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Each table as parquet under root/name/version=N; readers go on with the version before until all are there."""
    for name in [*ORDER, *sorted(set(tables) - set(ORDER))]:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{root}/{name}/version={version}")


def read_version(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/version={version}")


def send_embeddings(embeddings: DataFrame, connect: Callable[[], Callable[[list[tuple]], None]], size: int = SEND_ROWS) -> None:
    """Sends (embedding_id, work_id, chunk_index, chunk_text, literal) to a store that takes vectors as literals; null vectors as null."""
    rows = embeddings.select("embedding_id", "work_id", "chunk_index", "chunk_text", vector_literal(F.col("embedding")).alias("literal"))
    send_in_batches(rows, connect, size)


def send_in_batches(df: DataFrame, connect: Callable[[], Callable[[list[tuple]], None]], size: int = SEND_ROWS) -> None:
    """Sends rows from the executors, ``size`` at a time; no row passes the driver.

    ``connect`` is called once for each partition that has rows and returns the
    sender. Partitions may be sent again after a failure, so it must be keyed.
    """
    ship_package(df.sparkSession)

    def run(rows: Iterator) -> None:
        send = None
        while batch := list(islice(rows, size)):
            send = send or connect()
            send([tuple(r) for r in batch])

    df.foreachPartition(run)
