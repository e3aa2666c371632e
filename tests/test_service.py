import pytest

from citeloom.sources.service import FileService, look_up, persistently, works_service

RECORD = "id string, title string, cited_by_count long, referenced_works array<string>"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('service')}"
    works = [(f"W{i}", f"title {i}" if i % 9 else None, f"t{i % 3}", i * 7 % 50, [f"W{i * 3 % 450}", f"W{i + 1}"]) for i in range(500)]
    df = spark.createDataFrame(works, "id string, title string, topic string, cited_by_count long, referenced_works array<string>")
    df.write.parquet(f"{path}/works")
    df.selectExpr("id AS citing", "explode(referenced_works) AS cited").write.parquet(f"{path}/edges")
    return path, works


def connect_to(path):
    return lambda: FileService(path)


@pytest.fixture
def source(spark, store):
    made = works_service(connect_to(store[0]), RECORD, wait=0.0)
    spark.dataSource.register(made)
    return made.name()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_listings_by_topic_in_calls(spark, store, source):
    rows = spark.read.format(source).option("topics", '["t0", "t2", "nobody", "t0"]').load()
    want = sorted(w[0] for w in store[1] if w[2] in ("t0", "t2"))
    assert ids(rows) == want
    first = spark.read.format(source).option("topics", '["t1"]').option("per_topic", 7).load()
    assert [r.id for r in first.collect()] == [w[0] for w in sorted((w for w in store[1] if w[2] == "t1"), key=lambda w: (-w[3], w[0]))[:7]]
    assert {r.topic for r in first.collect()} == {"t1"} and first.select("cites").distinct().first()[0] is None


def test_filters_reach_the_service(spark, store):
    made = works_service(connect_to(store[0]), RECORD, name="filtered", filters=True, wait=0.0)
    spark.dataSource.register(made)
    source = made.name()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        asked = [f"W{i}" for i in range(0, 400, 2)] + ["unknown", "W2"]
        got = spark.read.format(source).load().where("id IN ({})".format(", ".join(f"'{a}'" for a in asked)))
        assert ids(got) == sorted(f"W{i}" for i in range(0, 400, 2))
        assert ids(spark.read.format(source).load().where("id = 'W7' AND title IS NOT NULL")) == ["W7"]
        assert ids(spark.read.format(source).load().where("topic = 't1' AND cited_by_count > 45")) == sorted(w[0] for w in store[1] if w[2] == "t1" and w[3] > 45)
        citing = spark.read.format(source).load().where("cites IN ('W3', 'W9')").select("cites", "id")
        assert sorted(map(tuple, citing.collect())) == sorted({(r, w[0]) for w in store[1] for r in w[4] if r in ("W3", "W9")})
        with pytest.raises(Exception, match="cannot list everything"):
            spark.read.format(source).load().where("title = 'x'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tables_of_ids(spark, store):
    asked = spark.createDataFrame([(f"W{i % 450}",) for i in range(1000)] + [(None,), ("unknown",)], "id string")
    assert ids(look_up(asked, connect_to(store[0]), RECORD, wait=0.0)) == sorted(f"W{i}" for i in range(450))
    got = look_up(asked.where("id IN ('W1', 'W30')"), connect_to(store[0]), RECORD, "cites", wait=0.0).select("cites", "id").collect()
    assert sorted(map(tuple, got)) == sorted({(r, w[0]) for w in store[1] for r in w[4] if r in ("W1", "W30")})
    assert look_up(asked.limit(0), connect_to(store[0]), RECORD).collect() == []


def test_pages_of_citing_works(spark, store, monkeypatch):
    from citeloom.sources import service

    monkeypatch.setattr(service, "CALL_ROWS", 2)
    found = [x[1]["id"] for x in service.records_of(FileService(store[0]), service.Call("cites", ["W0", "W3"]), 1, 0)]
    assert sorted(set(found)) == sorted({w[0] for w in store[1] for r in w[4] if r in ("W0", "W3")}) and len(found) > 2


def failing(path, times):
    """Every method fails ``times`` times in each process."""

    class Failing(FileService):
        left = times

        def __getattribute__(self, name):
            if name in ("by_ids", "count", "listing", "citing") and Failing.left:
                Failing.left -= 1
                raise ConnectionError("planted")
            return super().__getattribute__(name)

    return lambda: Failing(path)


def test_a_service_that_fails_twice_still_delivers(spark, store):
    flaky = works_service(failing(store[0], 2), RECORD, name="flaky", wait=0.01)
    spark.dataSource.register(flaky)
    assert len(ids(spark.read.format("flaky").option("ids", '["W1", "W2"]').load())) == 2
    assert len(ids(spark.read.format("flaky").option("topics", '["t1"]').load())) == 167
    dead = works_service(failing(store[0], 3), RECORD, name="dead", wait=0.01)
    spark.dataSource.register(dead)
    with pytest.raises(Exception, match="planted"):
        spark.read.format("dead").option("ids", '["W1"]').load().collect()


def test_back_off_grows():
    waits, tried = [], []
    import citeloom.sources.service as service

    def call():
        tried.append(1)
        if len(tried) < 3:
            raise OSError
        return "there"

    real, service.time.sleep = service.time.sleep, waits.append
    try:
        assert persistently(call, 3, 1.5) == "there" and waits == [1.5, 3.0]
    finally:
        service.time.sleep = real


def test_streams_follow_listings(spark, store, source, tmp_path):
    def run():
        rows = spark.readStream.format(source).option("topics", '["t0", "t1"]').load()
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    run()
    run()  # nothing new, nothing twice
    want = spark.read.format(source).option("topics", '["t0", "t1"]').load()
    assert ids(spark.read.parquet(f"{tmp_path}/out")) == ids(want)
    with pytest.raises(Exception, match="topics"):
        spark.readStream.format(source).load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c2").start().awaitTermination()


def test_ids_in_order_are_read_once(spark, store, tmp_path, monkeypatch):
    """Row groups of works in the order of their ids are opened once each, however many calls ask for them; unknown ids open none twice."""
    import pyarrow.parquet as pq

    rows = sorted(store[1])
    (tmp_path / "works").mkdir()
    table = spark.read.parquet(f"{store[0]}/works").orderBy("id").toArrow()
    pq.write_table(table, tmp_path / "works/a.parquet", row_group_size=50)
    opened = []

    class Counting(FileService):
        def _group(self, fragment, number):
            if (fragment.path, number) not in self._held:
                opened.append(number)
            return super()._group(fragment, number)

    service = Counting(str(tmp_path))
    asked = sorted([w[0] for w in rows] + [f"W{i}x" for i in range(500)])
    got = [r for i in range(0, len(asked), 7) for r in service.by_ids(asked[i : i + 7])]
    assert [(r["id"], r["title"], r["referenced_works"]) for r in got] == [(w[0], w[1], w[4]) for w in rows]
    assert sorted(opened) == list(range(10))
