import random
import re
from pathlib import Path

import pytest

from citeloom.operators import postings
from citeloom.operators.postings import build_postings, find_topics
from citeloom.operators.snowball import match_topics
from citeloom.scratch import scratch_root

WORDS = ["graph", "network", "ünï", "data", "the", "of", "x1", "日本", "rare"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        said = [w for w in WORDS[:-1] if rng.random() < 0.5] + (["the"] * 3 if i % 2 else []) + (["rare"] if i % 97 == 0 else [])
        rng.shuffle(said)
        rows.append((f"W{i}", rng.choice(["Graph-The", None, ""]), rng.choice([", ", " ", "\n"]).join(s.upper() if rng.random() < 0.2 else s for s in said) if i % 31 else None, rng.choice([None, *range(20)])))
    df = spark.createDataFrame(rows, "work_id string, title string, narrative_abstract string, cited_by_count long").repartition(4)
    path = f"file://{tmp_path_factory.mktemp('postings')}/index"
    build_postings(df, path)
    return df, path, rows


def brute(rows, topics, per_topic=None):
    out = []
    for topic in set(topics):
        need = set(topic.lower().split())
        hits = [r for r in rows if need and need <= set(re.split(r"[\W_]+", f"{r[1] or ''} {r[2] or ''}".lower()))]
        hits.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        out += [(topic, r[0], r[3]) for r in hits[:per_topic]]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("topic", "work_id", "cited_by_count").collect()), key=repr)


def some_topics(spark, n):
    rng = random.Random(7)
    topics = [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n)] + ["", "  ", "unheard of", "Graph NETWORK", "x1", "x1"]
    return topics, spark.createDataFrame([(t,) for t in topics] + [(None,)], "topic string")


def test_equals_the_scan(spark, corpus):
    df, path, _ = corpus
    topics = ("graph network", "the", "rare data", "x1 日本 of")
    got = find_topics(spark, path, spark.createDataFrame([(t,) for t in topics], "topic string"))
    assert rows_of(got) == rows_of(match_topics(df, topics))


def test_thousands_of_topics(spark, corpus):
    topics, table = some_topics(spark, 2000)
    assert rows_of(find_topics(spark, corpus[1], table)) == brute(corpus[2], topics)


@pytest.mark.parametrize("n", [1, 7])
def test_most_cited_with_an_early_end(spark, corpus, n, monkeypatch):
    monkeypatch.setattr(postings, "FIRST_READ", 1)
    monkeypatch.setattr(postings, "FURTHER", 3)
    topics, table = some_topics(spark, 60)
    assert rows_of(find_topics(spark, corpus[1], table, n)) == brute(corpus[2], topics, n)


def test_texts_are_not_read_and_lists_are_whole(spark, corpus):
    plan = find_topics(spark, corpus[1], some_topics(spark, 5)[1])._jdf.queryExecution().toString()
    assert "narrative_abstract" not in plan and "title" not in plan
    lists = spark.read.parquet(f"{corpus[1]}/lists")
    for r in lists.groupBy("term").agg({"place": "max", "work_id": "count"}).collect():
        assert r["max(place)"] == r["count(work_id)"] - 1


def test_empty(spark, tmp_path):
    build_postings(spark.createDataFrame([], "work_id string, title string, narrative_abstract string, cited_by_count long"), f"file://{tmp_path}/e")
    table = spark.createDataFrame([("a",)], "topic string")
    assert find_topics(spark, f"file://{tmp_path}/e", table).collect() == [] and find_topics(spark, f"file://{tmp_path}/e", table, 3).collect() == []


def test_long_lists_are_placed_in_slices(spark, corpus, monkeypatch, tmp_path):
    """With slices of a few works most lists are long; places and results are as in one piece."""
    df, whole, _ = corpus
    monkeypatch.setattr(postings, "SLICE_WORKS", 30)
    build_postings(df, f"file://{tmp_path}/index")
    columns = ["term", "work_id", "cited_by_count", "place", "bucket"]
    sliced, one = (sorted(map(tuple, spark.read.parquet(f"{p}/lists").select(*columns).collect()), key=repr) for p in (f"file://{tmp_path}/index", whole))
    assert sliced == one


def test_postings_are_shuffled_and_written_once(spark, corpus, tmp_path):
    """No copy of the postings lies beside the lists: scratch tables hold less than a tenth of their rows."""
    root = Path(scratch_root(spark).removeprefix("file://"))
    before = set(root.glob("*"))
    build_postings(corpus[0], f"file://{tmp_path}/index")
    lists = spark.read.parquet(f"file://{tmp_path}/index/lists").count()
    assert sum(spark.read.parquet(f"file://{p}").count() for p in set(root.glob("*")) - before) < lists / 10
