import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import ann, search
from citeloom.scratch import scratch_root

SCHEMA = "work_id string, embedding array<float>"


def clustered(n, d=12, seed=1, groups=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(f"W{i // 2}", [float(np.float32(x)) for x in centres[rng.integers(groups)] + 0.2 * rng.normal(size=d)]) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = clustered(900)
    rows += [("copy", rows[0][1])] * 250 + [("Z", [0.0] * 12), (None, rows[3][1]), ("short", [1.0] * 3), ("none", None), ("hole", [None] + [1.0] * 11)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, v) for i, (_, v) in enumerate(clustered(40, seed=2))]
    rows += [(100, clustered(1)[0][1]), (101, None), (102, [1.0, 2.0]), (103, [None] * 12), (104, [0.0] * 12), (105, [])]
    return spark.createDataFrame(rows, "query_id long, vector array<float>")


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ann')}/index"
    ann.build_index(table, path, cells=12)
    return path


def rows_of(df):
    return sorted((r.query_id, r.rank, str(r.work_id), r.similarity) for r in df.collect())


def test_all_cells_equal_the_exact_search(spark, table, queries, index):
    same_length = table.where("embedding IS NOT NULL AND size(embedding) = 12")
    asked = queries.where("size(vector) = 12")
    assert rows_of(ann.search_index(spark, index, queries, 7, 10**6)) == rows_of(search.knn(same_length, asked, 7))


def test_few_cells_have_high_recall_and_are_all_that_is_read(spark, table, queries, index):
    exact = search.knn(table, queries.where("query_id < 40"), 7)
    found = ann.search_index(spark, index, queries.where("query_id < 40"), 7, 3)
    assert ann.recall(found, exact).first().recall > 0.9
    one = queries.where("query_id = 0")
    plan = ann.search_index(spark, index, one, 7, 2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_recall_grows_with_probes(spark, table, queries, index):
    exact = search.knn(table, queries.where("query_id < 40"), 5).persist()
    recalls = [ann.recall(ann.search_index(spark, index, queries.where("query_id < 40"), 5, p), exact).first().recall for p in (1, 4, 12)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_every_vector_is_indexed_once(spark, table, index):
    cells = spark.read.parquet(f"{index}/cells")
    want = table.where("embedding IS NOT NULL AND size(embedding) = 12 AND NOT exists(embedding, x -> x IS NULL)").groupBy("work_id").count()
    got = cells.select(F.explode("works").alias("work_id")).groupBy("work_id").count()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert cells.select("cell").distinct().count() > 5


def test_small_chunks_and_big_query_tables(spark, table, queries, index, monkeypatch, tmp_path):
    """Chunks of a few vectors, blocks of a few queries, query blocks too many to broadcast, results held in pieces."""
    monkeypatch.setattr(ann, "ROW_BLOCK", 10)
    monkeypatch.setattr(ann, "HELD_QUERIES", 5)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "broadcast_if_small", lambda df: df)
    path = f"file://{tmp_path}/index"
    ann.build_index(table, path, cells=5)
    same_length = table.where("embedding IS NOT NULL AND size(embedding) = 12")
    assert rows_of(ann.search_index(spark, path, queries, 7, 10**6)) == rows_of(search.knn(same_length, queries.where("size(vector) = 12"), 7))


def test_empty_tables_and_doubles(spark, queries, tmp_path):
    ann.build_index(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert ann.search_index(spark, f"file://{tmp_path}/e", queries, 3, 1).collect() == []
    wide = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "work_id string, embedding array<double>")
    ann.build_index(wide, f"file://{tmp_path}/d")
    asked = spark.createDataFrame([(1, [0.0, 2.0])], "query_id long, vector array<double>")
    assert rows_of(ann.search_index(spark, f"file://{tmp_path}/d", asked, 3, 1)) == [(1, 1, "b", 0.8), (1, 2, "a", 0.0)]
    assert ann.search_index(spark, f"file://{tmp_path}/d", asked.limit(0), 3, 1).collect() == []


def scattered(n, d=12, seed=4):
    return [[float(x) for x in v] for v in np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)]


def test_probes_are_not_written_for_each_query_and_cell(spark, tmp_path, monkeypatch):
    """600 queries that probe half of 200 cells leave less on disk than a fifth of their vectors by those cells; two passes give what one does."""
    d, n = 32, 600
    rows = [(f"W{i}", v) for i, v in enumerate(scattered(4000, d))]
    queries = spark.createDataFrame(list(enumerate(scattered(n, d, 5))), "query_id long, vector array<float>")
    ann.build_index(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/index", cells=200)
    before = {str(p) for p in _scratch_files(spark)}
    found = rows_of(ann.search_index(spark, f"file://{tmp_path}/index", queries, 5, 100))
    written = sum(p.stat().st_size for p in _scratch_files(spark) if str(p) not in before)
    assert len(found) == 5 * n and written < n * 100 * d * 8 / 5
    monkeypatch.setattr(ann, "PASS_BYTES", n * d * 8 * 2 // 3)
    assert rows_of(ann.search_index(spark, f"file://{tmp_path}/index", queries, 5, 100)) == found


def _scratch_files(spark):
    return [p for p in Path(scratch_root(spark).removeprefix("file://")).rglob("*.parquet")]


def test_copies_of_a_vector_make_few_candidates(spark, tmp_path):
    """Of a vector that thousands of works have, a chunk gives a query the works with the smallest ids."""
    own = scattered(300)
    rows = [(f"W{i:05d}", own[0]) for i in range(3000)] + [(f"W{i:05d}", own[0]) for i in range(2)] + [(f"X{i}", v) for i, v in enumerate(own)]
    table = spark.createDataFrame(rows, SCHEMA)
    ann.build_index(table, f"file://{tmp_path}/index", cells=9)
    queries = spark.createDataFrame(list(enumerate(own[:20])), "query_id long, vector array<float>")
    before = {str(p) for p in _scratch_files(spark)}
    assert rows_of(ann.search_index(spark, f"file://{tmp_path}/index", queries, 7, 9)) == rows_of(search.knn(table, queries, 7))
    new = {str(p.parent) for p in _scratch_files(spark) if str(p) not in before and p.parent.name.startswith("candidates-")}
    assert sum(spark.read.parquet(f"file://{p}").count() for p in new) < 3000


def test_an_index_of_many_cells_has_few_folders(spark, tmp_path):
    ann.build_index(spark.createDataFrame([(f"W{i}", v) for i, v in enumerate(scattered(600))], SCHEMA), f"file://{tmp_path}/index", cells=300)
    assert len(list((tmp_path / "index/cells").glob("*=*"))) <= ann.FOLDERS < 300
