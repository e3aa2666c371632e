"""Incremental ingestion of record files into bronze tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.folds import fold_progress
from citeloom.schemas import TOPIC, WORK
from citeloom.sources.records import stream_records


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, schema: str, origin: str, keep_file: bool = True, now: Column | None = None) -> None:
    """Appends new files of ``source`` to the parquet table and returns when all are in.

    The checkpoint remembers what was read, so a second run adds only what is
    new, and a failed run goes on where it stopped.
    """
    rows = stream_records(spark, source, schema)
    rows = rows if keep_file else rows.drop("_source_file")
    rows = rows.withColumn("_ingested_at", F.current_timestamp() if now is None else now).withColumn("_source", F.lit(origin))
    query = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_works(spark: SparkSession, source: str, table: str, checkpoint: str) -> DataFrame:
    ingest(spark, source, table, checkpoint, WORK, "api_snowball")
    return spark.read.parquet(table)


def ingest_topics(spark: SparkSession, source: str, table: str, checkpoint: str) -> DataFrame:
    ingest(spark, source, table, checkpoint, TOPIC, "snapshot_dim", keep_file=False)
    return spark.read.parquet(table)


def stream_by_batch(rows: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch and its number to ``apply``; repeats after a failure carry the same number."""
    rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress_of(log_table: DataFrame) -> DataFrame:
    """The current progress from an ingested log; the fold does not mind repeated or late rows."""
    return fold_progress(log_table.dropDuplicates(["seq"]))
