import glob
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.sources.sink import BatchSink, FolderStore, _StreamWriter, latest, published, read_sink, send_batch, send_stream

SCHEMA = "id long, v string"


def rows_of(spark, path):
    return sorted(tuple(r) for r in read_sink(spark, path, SCHEMA).select("_batch", "id", "v").collect())


def files(root):
    return glob.glob(f"{root}/data/*.parquet")


def frame(spark, first, n, v="a"):
    return spark.range(first, first + n, 1, 4).select("id", F.lit(v).alias("v"))


def test_batches_are_read_back_and_upserted(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    send_batch(frame(spark, 0, 50), path, 1, rows=7)
    send_batch(frame(spark, 40, 20, "b"), path, 2)
    assert rows_of(spark, path) == [(1, i, "a") for i in range(50)] + [(2, i, "b") for i in range(40, 60)]
    now = sorted(tuple(r) for r in latest(read_sink(spark, path, SCHEMA), ["id"]).collect())
    assert now == [(i, "a" if i < 40 else "b") for i in range(60)]
    assert sorted((r.batch, r.rows) for r in published(spark, path).select("batch", "rows").distinct().collect()) == [(1, 50), (2, 20)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    send_batch(frame(spark, 0, 10), path, 5)
    before = rows_of(spark, path), sorted(files(tmp_path / "s"))
    send_batch(frame(spark, 0, 10), path, 5)
    send_batch(frame(spark, 100, 10, "other"), path, 5)
    assert (rows_of(spark, path), sorted(files(tmp_path / "s"))) == before


@pytest.mark.parametrize("at", [0, 13, 39])
def test_a_task_that_fails_half_way_leaves_nothing(spark, tmp_path, at):
    path = f"file://{tmp_path}/s"
    send_batch(frame(spark, 0, 10), path, 1)
    kept = files(tmp_path / "s")

    def broken(batches):
        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() == at:
                    raise RuntimeError("planted")
                yield b.slice(i, 1)

    with pytest.raises(Exception, match="planted"):
        send_batch(frame(spark, 0, 40).mapInArrow(broken, SCHEMA), path, 2, rows=2)
    assert rows_of(spark, path) == [(1, i, "a") for i in range(10)]
    time.sleep(2)  # tasks that are being killed may still leave a file, which nothing names
    FolderStore(path).vacuum(0)
    assert sorted(files(tmp_path / "s")) == sorted(kept)
    send_batch(frame(spark, 0, 40, "again"), path, 2)
    assert len(rows_of(spark, path)) == 50


def test_staged_rows_are_invisible_and_discarded(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    send_batch(frame(spark, 0, 3), path, 1)
    store = FolderStore(path)
    one = pa.RecordBatch.from_pydict({"id": [9], "v": ["x"]})
    name, n = store.stage(iter([one]), 10)
    assert n == 1 and len(rows_of(spark, path)) == 3
    store.discard([name, "never-written"])
    assert store.stage(iter([]), 10) == (None, 0)

    def stops():
        yield one
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.stage(stops(), 10)
    assert len(rows_of(spark, path)) == 3
    assert store.vacuum() == [] and store.vacuum(0) == []
    writer = _StreamWriter(path, 10)
    message = writer.write(iter([one]))
    writer.abort([message, None], 3)
    assert not store.has(3)
    writer.commit([writer.write(iter([one])), None], 4)
    assert store.has(4) and len(rows_of(spark, path)) == 4


def test_stream_restarts_and_replays(spark, tmp_path):
    source, path, check = f"{tmp_path}/in", f"file://{tmp_path}/s", f"{tmp_path}/check"
    frame(spark, 0, 10).write.parquet(source)
    read = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    send_stream(read(), path, check)
    frame(spark, 10, 5).write.mode("append").parquet(source)
    send_stream(read(), path, check)
    assert [r[1:] for r in rows_of(spark, path)] == [(i, "a") for i in range(15)]
    send_stream(read(), path, f"{tmp_path}/lost-checkpoint")  # all again, as batch 0
    assert [r[1:] for r in rows_of(spark, path)] == [(i, "a") for i in range(15)]


def test_empty_batches_and_missing_options(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    send_batch(frame(spark, 0, 2), path, 1)
    send_batch(frame(spark, 0, 2).where("false"), path, 2)
    assert published(spark, path).where("batch = 2").first().rows == 0 and len(rows_of(spark, path)) == 2
    spark.dataSource.register(BatchSink)
    with pytest.raises(Exception, match="batch"):
        frame(spark, 0, 1).write.format("citeloom_batches").option("path", path).mode("append").save()
    with pytest.raises(Exception, match="overwrit"):
        frame(spark, 0, 1).write.format("citeloom_batches").option("path", path).option("batch", 3).mode("overwrite").save()
