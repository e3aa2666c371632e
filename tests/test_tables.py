import json
import math
import random

from pyspark.sql import functions as F

from citeloom.functions.vectors import hashing_embedder
from citeloom.operators import folds, search
from citeloom.operators.serving import Library
from citeloom.plans import fixture as fx
from citeloom.plans import gates, medallion
from citeloom.schemas import CONSTRAINTS, WORK
from citeloom.sources import records
from citeloom.streaming import ingest


def record(i, **more):
    base = {"id": f"https://works.example/W{i}", "display_name": f"title {i}", "publication_year": 2000, "cited_by_count": 3, "_seed_topic": "t one", "_hop": "seed", "abstract_inverted_index": {f"word{k}": [k] for k in range(30)}, "referenced_works": ["https://works.example/W1"], "authorships": [{"author": {"id": "https://a.example/A1", "display_name": "N"}}, {"author": {"id": "https://a.example/A1", "display_name": "B"}, "is_corresponding": True}, {"author": {"id": None}}]}
    return json.dumps(base | more)


def works_from(spark, lines):
    rows = spark.createDataFrame([(x, "f") for x in lines], "value string, _source_file string")
    return records.parse_records(rows, WORK)


def test_silver_rules(spark):
    lines = [record(1), record(1, _hop="cited", _seed_topic="a"), record(2, display_name=None), record(3, display_name="  "), record(4, publication_year=1799), record(5, publication_year=None), record(6, publication_year=2027), record(7, publication_year=2028), record(8, abstract_inverted_index=json.dumps({"x" * 101: [0]})), record(9, abstract_inverted_index={"x" * 100: [0]}), record(10, abstract_inverted_index=None, referenced_works=None), record(11, cited_by_count=None, referenced_works=None, open_access=None)]
    raw = works_from(spark, lines)
    silver = {r.work_id: r for r in medallion.silver_works(raw, 2026).collect()}
    assert sorted(silver, key=lambda w: int(w[1:])) == ["W1", "W5", "W6", "W8", "W11"]
    assert (silver["W1"].seed_topic, silver["W1"]._hop, silver["W1"].referenced_works) == ("t one", "seed", ["W1"])
    assert (silver["W11"].cited_by_count, silver["W11"].is_oa, silver["W11"].referenced_works) == (0, False, [])
    counts = {r.gate: (r.passed, r.failed) for r in gates.gate_metrics(medallion.cleaned_works(raw), gates.works_gates(2026)).collect()}
    assert counts == {"valid_id": (11, 0), "has_title": (9, 2), "has_abstract": (9, 2), "plausible_year": (9, 2)}
    w = medallion.silver_works(raw, 2026)
    assert [tuple(r) for r in medallion.silver_paper_authors(w.where("work_id = 'W1'")).collect()] == [("W1", "A1", 0, False)]
    assert [tuple(r) for r in medallion.silver_authors(w).collect()] == [("A1", "B", None)]


def test_rescue_and_quarantine(spark):
    rows = works_from(spark, [record(1, extra={"a": 1}), record(2, publication_year="x"), "{broken", "", record(3)]).collect()
    by = {r.id and r.id[-1]: r for r in rows}
    assert len(rows) == 4 and json.loads(by["1"]._rescued_data) == {"extra": '{"a":1}'} and by["1"]._corrupt_record is None
    nested = works_from(spark, [record(1, authorships=[{"author": {"id": "A1", "age": 9}}, {"author": None, "new": [1], "institutions": [{"id": "I"}, {"id": "J", "city": {"x": 1}}]}], primary_topic={"field": {"id": "F", "why": "w"}, "score": 1}, open_access="odd")]).first()
    assert json.loads(nested._rescued_data) == {"authorships[0].author.age": "9", "authorships[1].new": "[1]", "authorships[1].institutions[1].city": '{"x":1}', "primary_topic.field.why": "w"}
    assert by["2"].publication_year is None and by["2"].display_name == "title 2" and by["2"]._corrupt_record
    assert by[None]._corrupt_record == "{broken" and by["3"]._rescued_data is None


def test_incremental_ingestion(spark, tmp_path):
    src, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    for k, n in enumerate((3, 2)):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(record(10 * k + i) for i in range(n)))
        for _ in range(2):
            bronze = ingest.ingest_works(spark, src, out, progress)
            assert bronze.count() == (3, 5)[k]
    assert {r._source for r in bronze.collect()} == {"api_snowball"} and bronze.where("_source_file like '%.jsonl'").count() == 5
    seen = []
    ingest.stream_by_batch(records.stream_records(spark, src, WORK), str(tmp_path / "p2"), lambda df, i: seen.append((i, df.count())))
    assert seen == [(0, 5)]
    records.write_jsonl(spark.read.json(src), str(tmp_path / "again"))
    assert spark.read.json(str(tmp_path / "again" / "slug=t_one")).count() == 5


def test_snapshot_and_manifest(spark, tmp_path, sf):
    (tmp_path / "manifest").write_text(json.dumps({"entries": [{"url": "s3://b/x/1.parquet"}, {"url": "s3://b/x/2.parquet"}]}))
    assert records.manifest_files(spark, str(tmp_path / "manifest")) == ["https://b.s3.amazonaws.com/x/1.parquet", "https://b.s3.amazonaws.com/x/2.parquet"]
    assert records.read_snapshot(spark, [f"{sf}/part.parquet"], ["p_partkey"]).columns == ["p_partkey"]


def test_graph_invariants(spark, sf):
    works = fx.base(spark, sf)
    edges = medallion.silver_citation_edges(works)
    graph = medallion.gold_citation_graph(edges, works)
    assert graph.exceptAll(edges.distinct()).count() == 0 and graph.count() == graph.distinct().count()
    degrees = medallion.gold_paper_metrics(works, graph)
    assert degrees.agg(F.sum("in_corpus_in_degree")).first()[0] == graph.count() and degrees.count() == works.count()


def fold_one_by_one(log):
    state = {}
    for seq, user, work, status, ts in sorted(log):
        old = state.get((user, work), (None, None, None, None))
        state[user, work] = (status, old[1] or (ts if status == "in_progress" else None), ts if status == "completed" else None, max(ts, old[3] or ts))
    return state


def test_progress_fold(spark, sf):
    log = [tuple(r) for r in fx.progress_log(spark, sf).collect()]
    frame = spark.createDataFrame(log[::-1], fx.progress_log(spark, sf).schema)
    assert {(r.user_id, r.work_id): tuple(r)[2:] for r in folds.fold_progress(frame).collect()} == fold_one_by_one(log)
    assert sorted(ingest.progress_of(frame.union(frame)).collect()) == sorted(folds.fold_progress(frame).collect())


def test_membership_of_random_logs(spark):
    rng = random.Random(12)
    log = [(i, rng.choice(["add", "add", "remove", "rename"]), rng.choice([1, 2, None]), rng.choice("abcdefgh"), rng.randrange(1000)) for i in range(400)]
    there = {}
    for _, op, c, w, ts in log:
        if op == "add":
            there.setdefault((c, w), ts)
        elif op == "remove":
            there.pop((c, w), None)
    rows = spark.createDataFrame(rng.sample(log, len(log)), "seq long, op string, collection_id long, work_id string, ts long")
    assert {(r.collection_id, r.work_id): r.added_at for r in folds.fold_membership(rows).collect()} == there
    assert folds.fold_membership(rows.limit(0)).collect() == []


def test_membership_and_ids(spark):
    log = spark.createDataFrame([(1, "add", 1, "a", 10), (2, "add", 1, "a", 20), (3, "add", 1, "b", 30), (4, "remove", 1, "b", 40), (5, "remove", 1, "c", 50), (6, "add", 1, "b", 60)], "seq long, op string, collection_id long, work_id string, ts long")
    assert {(r.work_id, r.added_at) for r in folds.fold_membership(log).collect()} == {("a", 10), ("b", 60)}
    assert {(r.seq, r.n) for r in folds.with_ids(log.repartition(4), "n", 7).collect()} == {(i, i + 6) for i in range(1, 7)}
    assert {(r.work_id, r.ts) for r in folds.keep_first(log, ["work_id"]).collect()} == {("a", 10), ("b", 30), ("c", 50)}


def test_ids_of_many_wide_rows(spark):
    n = 400_000
    log = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("note"))
    wrong = F.count_if(~F.col("n").eqNullSafe(F.col("seq") + 6))
    got = folds.with_ids(log.repartition(16, F.xxhash64("seq")), "n", 7).agg(F.count("*"), F.count_distinct("n"), wrong, F.count_if(F.length("note") != 192)).first()
    assert tuple(got) == (n, n, 0, 0)


def paper(spark, rows):
    return spark.createDataFrame(rows, "work_id string, narrative_abstract string, synced_at int, embedded_at int").select("work_id", *[F.col(c) if c == "narrative_abstract" else F.lit("x").alias(c) for c in folds.PAPER_FIELDS], "synced_at", "embedded_at")


def test_upserts(spark):
    current = paper(spark, [("a", "same", 1, 1), ("b", "old", 1, 1), ("c", "kept", 1, 1), ("d", None, 1, 1)])
    incoming = paper(spark, [("a", "same", 0, 0), ("b", "new", 0, 0), ("e", "fresh", 0, 0), ("d", None, 0, 0)])
    got = {r.work_id: (r.narrative_abstract, r.synced_at, r.embedded_at) for r in folds.upsert_papers(current, incoming, F.lit(2)).collect()}
    assert got == {"a": ("same", 2, 1), "b": ("new", 2, None), "c": ("kept", 1, 1), "d": (None, 2, 1), "e": ("fresh", 2, None)}
    assert "c" not in {r.work_id for r in folds.upsert_papers(current, incoming, F.lit(2), prune=True).collect()}
    one = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    assert sorted(map(tuple, folds.upsert(one(("a", 1), ("b", 1)), one(("b", 2), ("c", 2)), ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, folds.add_missing(one(("a", 1)), one(("a", 2), ("c", 2), ("c", 2)), ["k"]).collect())) == [("a", 1), ("c", 2)]
    assert sorted(map(tuple, folds.replace_by_key(one(("a", 1), ("a", 2), ("b", 1)), one(("a", 9)), "k").collect())) == [("a", 9), ("b", 1)]


def test_constraints(spark):
    rows = spark.createDataFrame([("a", "t", 1800), ("b", " ", 2101), ("c", None, None)], "work_id string, title string, publication_year int")
    assert {tuple(r) for r in gates.violations(rows, CONSTRAINTS["papers"], "work_id").collect()} == {("b", "title_not_blank"), ("b", "year_plausible"), ("c", "title_present")}
    assert [r.work_id for r in gates.valid(rows, CONSTRAINTS["papers"]).collect()] == ["a"]


def test_owner_check(spark):
    requests = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "a"), (2, None), (3, "a"), (None, "a")], "collection_id int, user_id string")
    owned = spark.createDataFrame([(1, "a"), (2, None)], "collection_id int, user_id string")
    got = {(r.collection_id, r.user_id): r.verdict for r in gates.with_owner_check(requests, owned).collect()}
    assert got == {(1, "a"): "ok", (1, "b"): "denied", (1, None): "denied", (2, "a"): "denied", (2, None): "denied", (3, "a"): "missing", (None, "a"): "missing"}


def test_score_of_odd_impacts(spark):
    rows = spark.createDataFrame([(1, 2, 0.5), (0, 0, None), (0, 0, float("nan"))], "in_corpus_in_degree int, cited_by_count int, fwci double")
    a, b, c = [r.s for r in rows.select(medallion.foundational_score().alias("s")).collect()]
    assert abs(a - (3 * math.log(2) + math.log(3) + 0.5)) < 1e-12 and b == 0 and math.isnan(c)


def test_vectors_that_are_missing(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 1.0]), ("e", [None, 1.0])], "work_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [2.0]), (4, [])], "query_id long, vector array<float>")
    got = {(r.query_id, r.work_id) for r in search.knn(vectors, queries, 5).collect()}
    assert got == {(1, "a"), (1, "d"), (3, "c")}
    assert search.knn(vectors, queries.where("query_id = 2"), 5).collect() == []


def test_blocks_of_queries(spark, monkeypatch):
    """Any size of blocks and chunks, with blocks broadcast or copied, finds what plain scoring finds."""
    rnd = random.Random(7)
    vectors = [(f"w{i % 150}", [rnd.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    asked = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(23)]
    size = lambda v: math.sqrt(sum(x * x for x in v))
    want = {}
    for q, a in asked:
        best = {}
        for w, v in vectors:
            best[w] = max(best.get(w, -2), round(sum(x * y for x, y in zip(a, v)) / size(a) / size(v), 6))
        want |= {(q, n + 1): w for n, (w, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4])}
    rows, queries = spark.createDataFrame(vectors, "work_id string, embedding array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")
    for query_block, row_block, held in ((1024, 4096, 50_000), (5, 7, 3)):
        monkeypatch.setattr(search, "QUERY_BLOCK", query_block)
        monkeypatch.setattr(search, "ROW_BLOCK", row_block)
        monkeypatch.setattr(search, "HELD_QUERIES", held)
        assert {(r.query_id, r.rank): r.work_id for r in search.knn(rows, queries, 4).collect()} == want
    monkeypatch.setattr(search, "broadcast_if_small", lambda df: df)
    assert {(r.query_id, r.rank): r.work_id for r in search.knn(rows, queries, 4).collect()} == want


def test_queue_in_order(spark):
    papers = spark.createDataFrame([("a", "t", 3, None), ("b", "t", None, None), ("c", "t", 1, None), ("d", None, 0, None), ("e", "t", 0, 1), ("f", "t", 1, None)], "work_id string, narrative_abstract string, synced_at int, embedded_at int")
    assert [r.work_id for r in search.unembedded(papers, 3).collect()] == ["b", "c", "f"] and search.unembedded(papers).count() == 4


def test_search_filters_before_top_k(spark):
    papers = spark.createDataFrame([(f"w{i}", f"t{i}", 2000 + i if i else None, "f" if i % 2 else "g", "d", 1, 1.0, i % 3 == 0, None, "s") for i in range(8)], "work_id string, title string, publication_year int, primary_topic_field string, primary_topic_domain string, cited_by_count int, foundational_score double, is_oa boolean, oa_url string, seed_topic string")
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0 + c]) for i in range(8) for c in range(2)], "work_id string, embedding array<float>")
    got = [r.work_id for r in search.search(vectors, papers, [1.0, 0.0], 3, field="f").collect()]
    assert got == ["w7", "w5", "w3"]
    assert [r.work_id for r in search.search(vectors, papers, [1.0, 0.0], 9, year_from=2006).collect()] == ["w7", "w6"]
    assert [r.work_id for r in search.search(vectors, papers, [1.0, 0.0], 9, open_access_only=True).collect()] == ["w6", "w3", "w0"]
    many = search.search_many(vectors, papers, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>"), 3, field="f").orderBy("rank").collect()
    assert [r.work_id for r in many] == got and [r.similarity for r in many] == [r.similarity for r in search.search(vectors, papers, [1.0, 0.0], 3, field="f").collect()]
    assert (search.clamp_top_k(0), search.clamp_top_k(99)) == (1, 50)
    best = search.knn(vectors, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>"), 2).collect()
    assert {(r.query_id, r.rank): r.work_id for r in best} == {(1, 1): "w7", (1, 2): "w6", (2, 1): "w0", (2, 2): "w1"}


def test_refresh_embeddings(spark):
    papers = spark.createDataFrame([("a", "text a", None), ("b", "  ", None), ("c", "done", 1), ("d", None, None)], "work_id string, narrative_abstract string, embedded_at int")
    old = spark.createDataFrame([("a:0", "a", 0, "old", [1.0]), ("a:1", "a", 1, "old", [1.0]), ("c:0", "c", 0, "done", [1.0])], "embedding_id string, work_id string, chunk_index int, chunk_text string, embedding array<float>")
    new, marked = search.refresh_embeddings(papers, old, hashing_embedder, F.lit(5))
    assert {(r.embedding_id, r.chunk_text) for r in new.collect()} == {("a:0", "text a"), ("c:0", "done")}
    assert {r.work_id: r.embedded_at for r in marked.collect()} == {"a": 5, "b": 5, "c": 1, "d": None}
    again, _ = search.refresh_embeddings(marked, new, hashing_embedder, F.lit(6))
    assert again.count() == 2


def test_library(spark):
    papers = spark.createDataFrame([("w1", "One", 1.0), ("w2", "Two", 9.0), ("w3", "Three", None)], "work_id string, title string, foundational_score double")
    for name, kind in (("publication_year", "int"), ("primary_topic_field", "string"), ("primary_topic_domain", "string"), ("cited_by_count", "long"), ("is_oa", "boolean"), ("oa_url", "string"), ("seed_topic", "string")):
        papers = papers.withColumn(name, F.lit(None).cast(kind))
    edges = spark.createDataFrame([("w2", "w1"), ("w3", "w2")], "citing_work_id string, cited_work_id string")
    vectors = spark.createDataFrame([("w1", [1.0, 0.0]), ("w2", [0.0, 1.0])], "work_id string, embedding array<float>")
    lib = Library(spark, "me", {"papers": papers, "citation_edges": edges, "paper_embeddings": vectors}, clock=F.lit("2024-01-01").cast("timestamp"))
    assert lib.create_collection(" ")["error"] and lib.create_collection("x", goal_id=5)["error"]
    assert lib.create_learning_goal("g") == {"goal_id": 1} and lib.create_collection("c", 1) == {"collection_id": 1}
    for w in ("w3", "w2", "w1", "w1"):
        assert lib.add_to_collection(1, w) == {"ok": True}
    assert "does not exist" in lib.add_to_collection(1, "zz")["error"] and "does not exist" in lib.add_to_collection(7, "w1")["error"]
    assert [r.work_id for r in lib.get_reading_path(1).collect()] == ["w1", "w2", "w3"]
    assert [r.work_id for r in lib.save_reading_plan(1)["path"].collect()] == ["w1", "w2", "w3"]
    assert [(r.work_id, r.sequence_rank) for r in lib.get_collection(1)["papers"].collect()] == [("w1", 0), ("w2", 1), ("w3", 2)]
    assert [r.paper_count for r in lib.collections().collect()] == [3] and lib.goals().count() == 1 and lib.t["users"].count() == 1
    assert [r.work_id for r in lib.find_prerequisites("w2").collect()] == ["w1"] and [r.work_id for r in lib.find_unlocks("w2").collect()] == ["w3"]
    assert lib.compare_papers("w2", "w1").first().a_cites_b and "error" in lib.compare_papers("w2", "zz") and lib.explain_citation_link("w2", "w1").first().cites
    assert "error" in lib.record_reading_progress("w1", "bad") and lib.record_reading_progress("w1", "in_progress") == {"ok": True}
    assert lib.record_reading_progress("w1", "completed") == {"ok": True}
    r = lib.get_progress(1).first()
    assert (r.work_id, r.status) == ("w1", "completed") and r.started_at and r.completed_at
    assert "error" in lib.save_note("w1", " ") and lib.save_note("w1", "n", 1) == {"note_id": 1} and lib.notes("w1").count() == 1
    assert [x.work_id for x in lib.search_papers([1.0, 0.1], 5).collect()] == ["w1", "w2"] and "error" in lib.search_papers("q") and "error" in lib.search_papers(" ")
    assert "error" in lib.get_paper("zz") and lib.get_paper("w1")["unlocks"].count() == 1 and lib.topics().count() == 1
    other = Library(spark, "you", lib.t)
    assert "not authorized" in other.add_to_collection(1, "w1")["error"] and "not authorized" in other.get_collection(1, check_owner=True)["error"] and "papers" in other.get_collection(1)
    assert lib.remove_from_collection(1, "w1") == {"ok": True} and lib.get_collection(1)["papers"].count() == 2
    later = Library(spark, "me", lib.t, clock=F.lit("2025-05-05").cast("timestamp"))
    assert later.update_goal(1, status="paused") == later.update_note(1, "more") == {"ok": True}
    assert "error" in later.update_goal(1, status="odd") and "error" in later.update_goal(9) and "error" in later.update_note(1, " ") and "error" in Library(spark, "you", lib.t).update_note(1, "x")
    goal, note = later.goals().first(), later.notes().first()
    assert (goal.status, goal.title, note.note_text) == ("paused", "g", "more") and goal.updated_at == note.updated_at > goal.created_at == note.created_at
    lib.delete_goal(1)
    assert lib.t["collections"].first().goal_id is None
    assert lib.delete_collection(1) == {"ok": True} and lib.t["collection_papers"].count() == 0 and lib.notes().first().collection_id is None


def test_sync_versions_and_batches(spark, tmp_path):
    from citeloom.operators import sync
    from citeloom.settings import Settings

    papers = paper(spark, [("a", "x", 1, 1)])
    gold = {"papers": paper(spark, [("a", "y", 0, 0), ("b", "z", 0, 0)]), "authors": spark.createDataFrame([("A", "n", None)], "author_id string, display_name string, orcid string"), "paper_authors": spark.createDataFrame([("a", "A", 0)], "work_id string, author_id string, author_position int"), "citation_edges": spark.createDataFrame([("a", "b"), ("b", "a")], "citing_work_id string, cited_work_id string")}
    current = {"papers": papers, "authors": gold["authors"].withColumn("display_name", F.lit("old")), "paper_authors": gold["paper_authors"].limit(0), "citation_edges": gold["citation_edges"].where("citing_work_id = 'a'")}
    new = sync.sync(current, gold, F.lit(3))
    assert {r.table_name: r.n for r in sync.counts(new).collect()} == {"papers": 2, "authors": 1, "paper_authors": 1, "citation_edges": 2}
    assert new["authors"].first().display_name == "n"
    sync.write_version(new, str(tmp_path), 1)
    assert sync.read_version(spark, str(tmp_path), "papers", 1).count() == 2
    out = str(tmp_path / "sent")
    (tmp_path / "sent").mkdir()

    def connect():
        import uuid

        def send(rows):
            with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(str(r[0]) for r in rows))

        return send

    sync.send_in_batches(spark.range(25).repartition(2), connect, 10)
    got = sync.send_embeddings(spark.createDataFrame([("a:0", "a", 0, "t", [0.5])], "embedding_id string, work_id string, chunk_index int, chunk_text string, embedding array<float>"), lambda: print)
    assert got is None
    files = [p.read_text().split("\n") for p in (tmp_path / "sent").iterdir()]
    assert max(map(len, files)) <= 10 and sorted(int(x) for f in files for x in f) == list(range(25))
    spark.conf.set("citeloom.per_topic", "7")
    assert Settings.of(spark).per_topic == 7 and Settings.of(spark).chunk_size == 1500
    spark.conf.unset("citeloom.per_topic")
