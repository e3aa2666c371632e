"""The whole build: bronze in, every silver and gold table written once and read by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.plans import gates, medallion

TABLES = (
    "silver_works silver_authors silver_paper_authors silver_citation_edges silver_topics_dim "
    "gold_citation_graph gold_paper_metrics gold_topic_rollups gold_author_metrics gold_papers_for_serving"
).split()


def build(spark: SparkSession, works: DataFrame, topics: DataFrame | None, root: str, this_year: int | None = None, abstract: Column | None = None) -> dict[str, DataFrame]:
    """Writes the tables under ``root`` and returns their scans.

    silver_works feeds eight of them, so it is computed once; its narrow
    columns are all that later scans read. A run starts anew each time and
    replaces what is there.
    """
    out: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")

    put("silver_works", medallion.silver_works(works, this_year, abstract))
    w = out["silver_works"]
    put("silver_authors", medallion.silver_authors(w))
    put("silver_paper_authors", medallion.silver_paper_authors(w))
    put("silver_citation_edges", medallion.silver_citation_edges(w))
    if topics is not None:
        put("silver_topics_dim", medallion.silver_topics_dim(topics))
    put("gold_citation_graph", medallion.gold_citation_graph(out["silver_citation_edges"], w))
    put("gold_paper_metrics", medallion.gold_paper_metrics(w, out["gold_citation_graph"]))
    put("gold_topic_rollups", medallion.gold_topic_rollups(w))
    put("gold_author_metrics", medallion.gold_author_metrics(out["silver_paper_authors"], w))
    put("gold_papers_for_serving", medallion.gold_papers_for_serving(w, out["gold_paper_metrics"]))
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of every table; equal to what a consumer of the same version counts."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        counted = one if counted is None else counted.union(one)
    return counted


def warned(works: DataFrame) -> DataFrame:
    """Counts of the gates that only warn."""
    return gates.gate_metrics(works, gates.warn_gates())
