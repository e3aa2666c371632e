"""A scholarly corpus derived from the supplied tables.

They hold no citations, so works are documents, references follow the parts
of neighbouring order lines, authors are customers. Every rule is stated
twice: here over DataFrames, and in ``*_SQL`` for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.plans import medallion
from citeloom.scratch import materialize

THIS_YEAR = 2026
_URL = "https://works.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citing, cited) part keys of neighbouring lines of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("citing"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("cited"))
    return a.join(b, ["l_orderkey", "n"]).select("citing", "cited")


def raw_works(spark: SparkSession, sf_dir: str, refs: bool = False, authors: bool = False) -> DataFrame:
    """Work records; every tenth document is harvested twice. Arrays that are not asked for are null."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    name = lambda c: F.struct(none.alias("id"), c.alias("display_name"))
    works = docs.select(
        "doc_id",
        F.concat(F.lit(f"{_URL}W"), "doc_id").alias("id"),
        F.concat(F.lit("https://doi.example/"), "doc_id").alias("doi"),
        F.substring("text", 1, 60).alias("display_name"),
        F.expr("CASE WHEN doc_id % 17 <> 0 THEN CAST(1990 + doc_id % 35 AS INT) END").alias("publication_year"),
        F.col("n_chars").alias("cited_by_count"),
        F.expr("CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 50 AS DOUBLE) / 10 END").alias("fwci"),
        F.col("lang").alias("language"),
        F.struct(none.alias("id"), none.alias("display_name"), F.lit(None).cast("double").alias("score"), name(none).alias("subfield"), name(F.col("lang")).alias("field"), name(F.concat(F.lit("D"), F.col("doc_id") % 4)).alias("domain")).alias("primary_topic"),
        F.struct((F.col("doc_id") % 2 == 0).alias("is_oa"), none.alias("oa_status"), none.alias("oa_url")).alias("open_access"),
        F.col("text").alias("abstract"),
        F.col("source").alias("_seed_topic"),
        F.lit("seed").alias("_hop"),
    )
    if refs:
        r = references(spark, sf_dir).groupBy(F.col("citing").alias("doc_id")).agg(F.collect_list(F.concat(F.lit(f"{_URL}W"), "cited")).alias("referenced_works"))
        works = works.join(r, "doc_id", "left")
    else:
        works = works.withColumn("referenced_works", F.lit(None).cast("array<string>"))
    if authors:
        works = works.join(authorships(spark, sf_dir, docs.count()), "doc_id", "left")
    else:
        works = works.withColumn("authorships", F.lit(None).cast("array<string>"))
    again = works.where("doc_id % 10 = 0").withColumn("_seed_topic", F.lit("again")).withColumn("_hop", F.lit("cited"))
    return works.unionByName(again).drop("doc_id")


def authorships(spark: SparkSession, sf_dir: str, n_docs: int) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cust = F.col("o_custkey").cast("string")
    who = F.struct(
        F.concat(F.lit("https://authors.example/A"), cust).alias("id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("N. "), cust)).when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Name "), cust)).alias("display_name"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("orcid-"), cust)).alias("orcid"),
    )
    one = F.struct("o_orderkey", who.alias("author"), (F.col("o_orderkey") % 4 == 0).alias("is_corresponding"))
    return orders.groupBy((F.col("o_orderkey") % n_docs).alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("authorships"))


def works(spark: SparkSession, sf_dir: str, refs: bool = False, authors: bool = False) -> DataFrame:
    return medallion.silver_works(raw_works(spark, sf_dir, refs, authors), THIS_YEAR, F.col("abstract"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned works without their texts, with references: written once and read by every step of a query."""
    w = works(spark, sf_dir, refs=True)
    return materialize(w.drop("narrative_abstract", "authorships", "payload"), "works")


def light_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).drop("narrative_abstract", "referenced_works", "authorships", "payload")


def graph(b: DataFrame) -> DataFrame:
    return medallion.gold_citation_graph(medallion.silver_citation_edges(b), b)


def metrics(b: DataFrame) -> DataFrame:
    """Paper metrics with the score rounded, so that ties are the same in every engine."""
    m = medallion.gold_paper_metrics(b, graph(b))
    return m.withColumn("foundational_score", F.round("foundational_score", 6))


def scored_papers(b: DataFrame) -> DataFrame:
    return b.drop("referenced_works").join(metrics(b).select("work_id", "foundational_score"), "work_id")


def members(spark: SparkSession, sf_dir: str, b: DataFrame) -> DataFrame:
    """(collection_id, work_id): the parts of every order that are works."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("collection_id"), F.concat(F.lit("W"), "l_partkey").alias("work_id")).distinct()
    return lines.join(b.select("work_id"), "work_id", "left_semi")


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'signup' THEN 'not_started' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' ELSE 'abandoned' END")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("U"), "user_id").alias("user_id"), F.concat(F.lit("W"), k % 5).alias("work_id"), status.alias("status"), "ts")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("W"), F.expr("vec_id div 2")).alias("work_id"), (F.col("vec_id") % 2).cast("int").alias("chunk_index"), "embedding")


_COLUMNS = """'W' || doc_id AS work_id, doc_id, substring(text, 1, 60) AS title, 'https://doi.example/' || doc_id AS doi,
  CASE WHEN doc_id % 17 <> 0 THEN CAST(1990 + doc_id % 35 AS INTEGER) END AS publication_year, lang AS field,
  'D' || (doc_id % 4) AS domain, n_chars AS cited_by_count, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 50)::DOUBLE / 10 END AS fwci,
  doc_id % 2 = 0 AS is_oa, text AS abstract"""

CLEANED_SQL = f"""raw AS (
  SELECT {_COLUMNS}, source AS seed_topic, 'seed' AS hop, 1 AS hop_rank FROM documents
  UNION ALL SELECT {_COLUMNS}, 'again', 'cited', 2 FROM documents WHERE doc_id % 10 = 0
), cleaned AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY hop_rank, seed_topic) AS rn FROM raw) WHERE rn = 1
)"""

WORKS_SQL = f"""{CLEANED_SQL}, works AS (
  SELECT * FROM cleaned WHERE length(trim(title)) > 0 AND length(abstract) > 100
    AND (publication_year IS NULL OR publication_year BETWEEN 1800 AND {THIS_YEAR + 1})
)"""

EDGES_SQL = f"""{WORKS_SQL}, refs AS (
  SELECT 'W' || a.l_partkey AS citing, 'W' || b.l_partkey AS cited
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1
), edges AS (
  SELECT citing, cited FROM refs JOIN works ON citing = work_id
), graph AS (
  SELECT DISTINCT citing, cited FROM edges WHERE cited IN (SELECT work_id FROM works)
), metrics AS (
  SELECT work_id, title, coalesce(d, 0) AS in_degree, cited_by_count, fwci, publication_year, field, domain, is_oa, seed_topic, abstract, doi,
         round(3 * ln(1 + coalesce(d, 0)) + ln(1 + cited_by_count) + coalesce(fwci, 0), 6) AS score
  FROM works LEFT JOIN (SELECT cited, count(*) AS d FROM graph GROUP BY cited) ON cited = work_id
)"""

MEMBERS_SQL = f"""{EDGES_SQL}, members AS (
  SELECT DISTINCT l_orderkey AS c, 'W' || l_partkey AS w FROM lineitem WHERE 'W' || l_partkey IN (SELECT work_id FROM works)
)"""

AUTHORS_SQL = f"""{WORKS_SQL}, authored AS (
  SELECT 'W' || (o_orderkey % n) AS work_id, 'A' || o_custkey AS author_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'N. ' || o_custkey WHEN o_orderkey % 5 <> 0 THEN 'Name ' || o_custkey END AS display_name,
         CASE WHEN o_custkey % 2 = 0 THEN 'orcid-' || o_custkey END AS orcid, o_orderkey % 4 = 0 AS is_corresponding,
         CAST(row_number() OVER (PARTITION BY o_orderkey % n ORDER BY o_orderkey) - 1 AS INTEGER) AS author_position
  FROM orders, (SELECT count(*) AS n FROM documents)
), authorship AS (
  SELECT * FROM authored WHERE work_id IN (SELECT work_id FROM works)
)"""

PROGRESS_SQL = """log AS (
  SELECT event_id AS seq, 'U' || user_id AS user_id, 'W' || (CAST(json_extract(props, '$.k') AS BIGINT) % 5) AS work_id, ts,
         CASE event_type WHEN 'signup' THEN 'not_started' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'in_progress'
                         WHEN 'purchase' THEN 'completed' ELSE 'abandoned' END AS status
  FROM events
)"""
