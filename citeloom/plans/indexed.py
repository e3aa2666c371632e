"""Registered queries over indexes, sources, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from citeloom.operators import ann, levels, postings, search
from citeloom.plans import fixture as fx
from citeloom.plans import medallion
from citeloom.plans.incremental import GoldStore
from citeloom.plans.queries import _KNN_SQL, _STATE_SQL, TOPIC_WORDS_SQL, K, _query_vectors, query, snowball_sql
from citeloom.scratch import scratch_path
from citeloom.sources import service, sink
from citeloom.streaming.progress import stream_progress
from citeloom.streaming.schema_location import SchemaLocation, ingest_evolving, read_evolved

#: Each query probes this share of the cells: the supplied vectors have no clusters, so that neighbours lie in many cells.
PROBED_SHARE = 0.5


def _vector_index(spark, sf):
    path = scratch_path(spark, "vector-index")
    ann.build_index(fx.chunk_vectors(spark, sf), path)
    return path


@query("WITH " + _KNN_SQL.format(where=""))
def index_search_all_cells(spark, sf):
    return ann.search_index(spark, _vector_index(spark, sf), _query_vectors(spark, sf), K, ann.MAX_CELLS)


@query("SELECT count(*) AS queries, 10 * count(*) AS expected, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def index_recall(spark, sf):
    """Recall@10 of the index against the exact search, probing PROBED_SHARE of the cells; 0.9 or more is asked for."""
    path = _vector_index(spark, sf)
    cells = spark.read.parquet(f"{path}/centres").count()
    queries = _query_vectors(spark, sf)
    found = ann.search_index(spark, path, queries, K, max(1, round(cells * PROBED_SHARE)))
    out = ann.recall(found, search.knn(fx.chunk_vectors(spark, sf), queries, K))
    return out.select("queries", "expected", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(f"WITH {fx.WORKS_SQL} SELECT work_id, title, cited_by_count + CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 0 END AS cited_by_count FROM works")
def sink_papers(spark, sf):
    """Papers sent as a batch, then a third of them again with other counts, and that batch once more."""
    path = scratch_path(spark, "paper-sink")
    papers = fx.light_works(spark, sf).select("work_id", "title", "cited_by_count")
    third = papers.where("CAST(substring(work_id, 2) AS LONG) % 3 = 0").withColumn("cited_by_count", F.col("cited_by_count") + 1000)
    for number, rows in ((1, papers), (2, third), (2, third)):
        sink.send_batch(rows, path, number)
    return sink.latest(sink.read_sink(spark, path, "work_id string, title string, cited_by_count long"), ["work_id"])


# Record service -----------------------------------------------------------

#: Bytes of a row group of the service's works, which are in the order of their ids.
SERVICE_GROUP = 1 << 20
_RECORD = "id string, title string, cited_by_count long, referenced_works array<string>"


def _service(spark, sf, citing=False):
    """(works, connect): the corpus behind a record service, listed under its topics; with ``citing`` also who cites whom."""
    b = fx.base(spark, sf)
    path = scratch_path(spark, "service")
    works = b.select(F.col("work_id").alias("id"), "title", "cited_by_count", "referenced_works", F.col("seed_topic").alias("topic"))
    works.repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.block.size", SERVICE_GROUP).parquet(f"{path}/works")
    if citing:
        medallion.silver_citation_edges(b).select(F.col("citing_work_id").alias("citing"), F.col("cited_work_id").alias("cited")).distinct().write.parquet(f"{path}/edges")
    return b, lambda: service.FileService(path)


def _listed(spark, connect, per_topic, topics):
    source = service.works_service(connect, _RECORD)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("topics", json.dumps(topics)).option("per_topic", per_topic).load()


def _topics(b):
    return [r.seed_topic for r in b.select("seed_topic").where("seed_topic IS NOT NULL").distinct().orderBy("seed_topic").collect()]  # the topics of a harvest are parameters


@query(f"WITH {snowball_sql(5)} SELECT topic, work_id, title, cited_by_count FROM seeds JOIN works USING (work_id)")
def service_seeds(spark, sf):
    b, connect = _service(spark, sf)
    return _listed(spark, connect, 5, _topics(b)).select("topic", F.col("id").alias("work_id"), "title", "cited_by_count")


@query(f"WITH {snowball_sql(5)} SELECT DISTINCT topic, citing AS work_id FROM edges JOIN seeds ON cited = work_id WHERE citing IN (SELECT work_id FROM works)")
def service_citing(spark, sf):
    """What cites the first five works of each topic, asked of the service."""
    b, connect = _service(spark, sf, citing=True)
    seeds = _listed(spark, connect, 5, _topics(b)).select("topic", "id")
    citing = service.look_up(seeds.select("id"), connect, _RECORD, "cites").select("cites", F.col("id").alias("work_id"))
    return seeds.join(citing, seeds["id"] == citing["cites"]).select("topic", "work_id").distinct()


@query(f"WITH {fx.WORKS_SQL} SELECT work_id, title FROM works WHERE work_id IN (SELECT 'W' || l_partkey FROM lineitem WHERE l_quantity < 3)")
def service_look_up(spark, sf):
    _, connect = _service(spark, sf)
    asked = fx.table(spark, sf, "lineitem").where("l_quantity < 3").select(F.concat(F.lit("W"), "l_partkey").alias("id"))
    return service.look_up(asked, connect, _RECORD).select(F.col("id").alias("work_id"), "title")


# Streams -------------------------------------------------------------------


@query(f"WITH {_STATE_SQL} SELECT * FROM state")
def progress_stream(spark, sf):
    """The progress log as a stream of four files, a micro-batch each, late events among them."""
    path = scratch_path(spark, "progress-stream")
    log = fx.progress_log(spark, sf)
    log.repartition(4, F.pmod(F.xxhash64("seq"), F.lit(4))).write.parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    sink.send_stream(stream_progress(stream), f"{path}/out", f"{path}/check")
    columns = "user_id string, work_id string, status string, started_at timestamp, completed_at timestamp, updated_at timestamp, expired boolean"
    return sink.latest(sink.read_sink(spark, f"{path}/out", columns), ["user_id", "work_id"]).drop("expired")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS n_chars, CASE WHEN doc_id % 3 = 1 THEN lang END AS lang,
  CASE WHEN doc_id % 3 = 2 THEN source END AS origin_name, CASE WHEN doc_id % 3 = 2 THEN doc_id / 2 END AS ratio FROM documents""")
def evolving_ingest(spark, sf):
    """Records that gain fields, ingested in three runs with a schema location between them."""
    path = scratch_path(spark, "evolving")
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", F.struct(F.col("source").alias("name"), (F.col("doc_id") / 2).alias("ratio")).alias("origin"))
    for turn, columns in enumerate((["doc_id"], ["doc_id", "n_chars", "lang"], ["doc_id", "n_chars", "origin"])):
        docs.where(F.col("doc_id") % 3 == turn).select(*columns).write.mode("append").json(f"{path}/in")
        ingest_evolving(spark, f"{path}/in", f"{path}/table", f"{path}/check", SchemaLocation(f"{path}/schemas"))
    rows = read_evolved(spark, f"{path}/table", SchemaLocation(f"{path}/schemas"))
    return rows.select("doc_id", "n_chars", "lang", F.col("origin.name").alias("origin_name"), F.col("origin.ratio").alias("ratio"))


# Tables that follow changes --------------------------------------------------


@query(f"WITH {fx.EDGES_SQL} SELECT work_id, in_degree AS in_corpus_in_degree, cited_by_count, fwci, publication_year, score AS foundational_score FROM metrics")
def incremental_metrics(spark, sf):
    """Paper metrics after two rounds of changes: works that come, change and go leave what a full build gives."""
    b = fx.base(spark, sf).select("work_id", "cited_by_count", "fwci", "publication_year", "referenced_works", F.expr("CAST(substring(work_id, 2) AS LONG)").alias("n"))
    store = GoldStore(spark, scratch_path(spark, "gold-store"), 16)
    late = F.col("n") % 4 == 1
    passing = b.where(F.col("n") % 9 == 0).withColumn("work_id", F.concat(F.lit("X"), "work_id"))
    store.apply(b.where(~late).withColumn("referenced_works", F.when(F.col("n") % 10 == 0, F.slice("referenced_works", 1, 1)).otherwise(F.col("referenced_works"))).unionByName(passing))
    store.apply(b.where(late | (F.col("n") % 10 == 0)), passing.select("work_id"))
    out = store.metrics().withColumn("foundational_score", F.round("foundational_score", 6))
    return out.select("work_id", "in_corpus_in_degree", "cited_by_count", "fwci", "publication_year", "foundational_score")


# Topic search by an inverted index ------------------------------------------------

_ASKED = ("the and", "les des", "der die", "que los", "and der", "der", "no such words")
_TOPICS_SQL = TOPIC_WORDS_SQL.replace("'and der'", ", ".join(f"'{t}'" for t in _ASKED[4:]))


def _topic_index(spark, sf):
    docs = fx.table(spark, sf, "documents")
    path = scratch_path(spark, "topic-index")
    works = docs.select(F.concat(F.lit("W"), "doc_id").alias("work_id"), F.col("n_chars").cast("long").alias("cited_by_count"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("narrative_abstract"))
    postings.build_postings(works, path)
    return path, spark.createDataFrame([(t,) for t in _ASKED], "topic string")


@query(_TOPICS_SQL)
def topic_index_search(spark, sf):
    path, topics = _topic_index(spark, sf)
    return postings.find_topics(spark, path, topics)


@query(f"SELECT topic, work_id, cited_by_count FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cited_by_count DESC NULLS LAST, work_id) AS rn FROM ({_TOPICS_SQL})) WHERE rn <= 20")
def topic_index_most_cited(spark, sf):
    """The 20 most cited works of each topic, by stretches of the rarest word's list."""
    path, topics = _topic_index(spark, sf)
    return postings.find_topics(spark, path, topics, 20)


# Levels of the whole graph -----------------------------------------------------------


@query(f"""WITH RECURSIVE {fx.EDGES_SQL}, reach(a, b) AS (
  SELECT citing, cited FROM graph UNION SELECT a, cited FROM reach JOIN graph ON b = citing
), looped AS (SELECT a FROM reach WHERE a = b), blocked AS (
  SELECT a FROM looped UNION SELECT a FROM reach WHERE b IN (SELECT a FROM looped)
), walk(w, d) AS (
  SELECT work_id, 0 FROM works WHERE work_id NOT IN (SELECT a FROM blocked)
  UNION SELECT citing, d + 1 FROM walk JOIN graph ON cited = w WHERE citing NOT IN (SELECT a FROM blocked)
)
SELECT work_id, CAST(max(d) AS INTEGER) AS level, bool_or(b.a IS NOT NULL) AS in_citation_cycle
FROM works LEFT JOIN walk ON w = work_id LEFT JOIN (SELECT DISTINCT a FROM blocked) b ON b.a = work_id GROUP BY work_id""")
def graph_levels(spark, sf):
    """How deep the prerequisites of each work of the corpus go, and which works a cycle holds up."""
    b = fx.base(spark, sf)
    return levels.work_levels(b, fx.graph(b))
