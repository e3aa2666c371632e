"""A transactional sink for batches of rows, as a Python data source.

    spark.dataSource.register(BatchSink)
    df.write.format("citeloom_batches").option("path", p).option("batch", 7).mode("append").save()
    stream.writeStream.format("citeloom_batches").option("path", p).option("checkpointLocation", c).start()

A batch is seen whole or not at all, and once: tasks stage files, the commit
publishes them all by one entry in the log, an abort removes them, and a batch
whose number is in the log already changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from citeloom.fixed import SEND_ROWS
from citeloom.ranks import broadcast_if_small
from citeloom.shipping import ship_package


class FolderStore:
    """Batches of rows in a folder that driver and executors share: ``data`` holds files, ``log`` an entry a published batch."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def stage(self, batches: Iterator[pa.RecordBatch], rows: int) -> tuple[str | None, int]:
        """Writes a task's rows, ``rows`` at a time, to a file that nobody sees yet; what a failing task wrote is removed."""
        name, writer, n = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    if writer is None:
                        self.fs.create_dir(f"{self.root}/data")
                        out = self.fs.open_output_stream(f"{self.root}/data/{name}")
                        writer = parquet.ParquetWriter(out, b.schema)
                    part = b.slice(at, rows)
                    writer.write_batch(part)
                    n += part.num_rows
            if writer is not None:
                writer.close()
                out.close()
        except BaseException:
            if writer is not None:
                writer.close()
                out.close()
                self.discard([name])
            raise
        return (name if writer is not None else None), n

    def discard(self, names: list[str]) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.root}/data/{name}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/data/{name}")

    def vacuum(self, seconds: float = 86_400.0) -> list[str]:
        """Removes files that no entry of the log names and that are older than any write still running; returns their names.

        A task that is killed cannot tidy up, nor can an abort that comes before it has ended.
        """
        info = lambda folder: self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        named = set()
        for entry in info("log"):
            with self.fs.open_input_stream(entry.path) as file:
                named.update(json.loads(file.read())["files"])
        old = [i.base_name for i in info("data") if i.base_name not in named and (i.mtime_ns or 0) / 1e9 <= time.time() - seconds]
        self.discard(old)
        return old

    def _entry(self, batch: int) -> str:
        return f"{self.root}/log/{batch:020d}.json"

    def has(self, batch: int) -> bool:
        return self.fs.get_file_info(self._entry(batch)).type != pafs.FileType.NotFound

    def publish(self, batch: int, names: list[str], rows: int) -> bool:
        """Makes the files visible under ``batch`` in one step; False, and nothing changes, if the batch is there already."""
        if self.has(batch):
            self.discard(names)
            return False
        self.fs.create_dir(f"{self.root}/log")
        draft = f"{self.root}/log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batch, "files": names, "rows": rows}).encode())
        self.fs.move(draft, self._entry(batch))
        return True


@dataclass
class Staged(WriterCommitMessage):
    name: str | None
    rows: int


class _Task:
    """What batch and streaming writers share."""

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Staged(*FolderStore(self.path).stage(iterator, self.rows))

    def finish(self, messages: list, batch: int) -> None:
        staged = [m for m in messages if m is not None and m.name is not None]
        FolderStore(self.path).publish(batch, [m.name for m in staged], sum(m.rows for m in staged))

    def undo(self, messages: list) -> None:
        FolderStore(self.path).discard([m.name for m in messages if m is not None and m.name is not None])


class _BatchWriter(_Task, DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, batch: int) -> None:
        super().__init__(path, rows)
        self.batch = batch

    def commit(self, messages: list) -> None:
        self.finish(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.undo(messages)


class _StreamWriter(_Task, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 (Spark's name)
        self.finish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.undo(messages)


class BatchSink(DataSource):
    """Options: ``path``; ``batch``, the number of a batch write; ``rows``, rows in a group (default 1,000)."""

    @classmethod
    def name(cls) -> str:
        return "citeloom_batches"

    def _rows(self) -> int:
        return int(self.options.get("rows", SEND_ROWS))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("batches are appended; overwriting is not what this sink does")
        if "batch" not in self.options:
            raise ValueError("give the number of the batch as option 'batch', so that a repeated write changes nothing")
        return _BatchWriter(self.options["path"], self._rows(), int(self.options["batch"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], self._rows())


def send_batch(df: DataFrame, path: str, batch: int, rows: int = SEND_ROWS) -> None:
    """Writes ``df`` as batch number ``batch``."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(BatchSink)
    df.write.format(BatchSink.name()).option("path", path).option("batch", batch).option("rows", rows).mode("append").save()


def send_stream(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a stream's micro-batches under their own numbers, and returns when all input is in.

    In update mode, which Spark has for its own aggregations but not for a
    streaming writer in Python, so each micro-batch is a batch write.
    """

    def send(batch: DataFrame, number: int) -> None:
        send_batch(batch, path, number)

    df.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, path: str) -> DataFrame:
    """(batch, file, rows) of the log."""
    log = spark.read.schema("batch long, files array<string>, rows long").json(f"{path}/log")
    return log.select("batch", F.explode_outer("files").alias("file"), "rows")


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of published batches, with ``_batch``; only files that the log names are opened (the driver lists them, as for any table)."""
    files = published(spark, path).where("file IS NOT NULL").select("batch", "file").collect()
    if not files:
        return spark.createDataFrame([], f"{schema}, _batch long")
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{f.file}" for f in files])
    names = spark.createDataFrame(files, "_batch long, _file string")
    rows = rows.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(broadcast_if_small(names), "_file").drop("_file")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch: what a keyed store holds after all upserts."""
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


