import random
import time

import pytest

from citeloom.operators.folds import fold_progress
from citeloom.sources.sink import BatchSink, latest, read_sink, send_stream
from citeloom.streaming.progress import _EMPTY, advance, stream_progress

LOG = "seq long, user_id string, work_id string, status string, ts timestamp"
OUT = "user_id string, work_id string, status string, started_at timestamp, completed_at timestamp, updated_at timestamp, expired boolean"


def events(spark, n=400, seed=3):
    rng = random.Random(seed)
    states = ["not_started", "in_progress", "completed", "abandoned", "unheard of", None]
    rows = [(i, f"u{rng.randrange(6)}", f"w{rng.randrange(4)}" if i % 50 else None, rng.choice(states), f"2026-01-{1 + rng.randrange(28):02d} 00:00:{rng.randrange(60):02d}" if i % 13 else None) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, user_id string, work_id string, status string, ts string").selectExpr("seq", "user_id", "work_id", "status", "CAST(ts AS TIMESTAMP) AS ts")


def now_of(spark, path):
    return sorted((tuple(r) for r in latest(read_sink(spark, path, OUT), ["user_id", "work_id"]).drop("expired").collect()), key=repr)


@pytest.mark.parametrize("cuts", [1, 5])
def test_state_equals_the_fold_of_the_whole_log(spark, tmp_path, cuts):
    """However the log is cut, with late and repeated events, and with a restart after each cut."""
    log = events(spark).collect()
    random.Random(cuts).shuffle(log)
    source, path, check = f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check"
    size = -(-len(log) // cuts)
    for i in range(0, len(log), size):
        part = log[i : i + size] + log[max(0, i - 20) : i]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        send_stream(stream_progress(spark.readStream.schema(LOG).parquet(source)), path, check)
    want = fold_progress(spark.createDataFrame(log, LOG)).select("user_id", "work_id", "status", "started_at", "completed_at", "updated_at")
    assert now_of(spark, path) == sorted((tuple(r) for r in want.collect()), key=repr)


def test_idle_keys_expire(spark, tmp_path):
    """Timers run on processing time, so this stream goes on until it is stopped."""
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/out"
    one = spark.createDataFrame([(5, "u", "w", "completed", "2026-01-01 00:00:00")], "seq long, user_id string, work_id string, status string, ts string")
    one.selectExpr("seq", "user_id", "work_id", "status", "CAST(ts AS TIMESTAMP) AS ts").coalesce(1).write.parquet(source)
    spark.dataSource.register(BatchSink)
    rows = stream_progress(spark.readStream.schema(LOG).parquet(source), idle=300)
    query = rows.writeStream.format("citeloom_batches").option("path", path).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="500 milliseconds").start()
    got, until = [], time.time() + 40
    while time.time() < until and len(got) < 2:
        time.sleep(1)
        if list(tmp_path.glob("out/log/*.json")):
            got = [tuple(r) for r in read_sink(spark, path, OUT).select("status", "expired").orderBy("_batch").collect()]
    query.stop()
    assert got == [("completed", False), ("completed", True)]


def test_order_and_repeats_do_not_matter():
    log = [(3, "completed", 30), (1, "in_progress", 10), (2, "in_progress", 20), (None, "abandoned", 99), (4, "odd", None)]
    want = (4, None, None, 1, 10, 99)
    for seed in range(10):
        rows = log * 2
        random.Random(seed).shuffle(rows)
        assert advance(advance(_EMPTY, iter(rows[:4])), iter(rows[4:])) == want


def test_no_python_runs_for_each_key(spark, tmp_path):
    """Without timers the engine folds the stream; with them each key has its own state and timers in Python."""
    spark.createDataFrame([], LOG).write.parquet(f"{tmp_path}/in")
    log = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")
    plans = [stream_progress(log, idle)._jdf.queryExecution().analyzed().toString() for idle in (None, 300)]
    assert ["TransformWithState" in p for p in plans] == [False, True]
