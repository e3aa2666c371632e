"""Corpus construction by citation snowball."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.fixed import PER_TOPIC, TOPICS
from citeloom.functions.text import short_id
from citeloom.plans.medallion import hop_rank


def match_topics(works: DataFrame, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """(topic, work_id, cited_by_count): works whose title or abstract has all words of a topic.

    Topics are a short list of parameters, so this is one pass over the works
    and no join.
    """
    text = F.lower(F.concat_ws(" ", "title", "narrative_abstract"))
    words = F.split(text, r"[^\p{L}\p{N}]+")
    hits = [F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in t.lower().split()]), F.col("_words"))) == 0, F.lit(t)) for t in topics]
    rows = works.select("work_id", "cited_by_count", words.alias("_words"))
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("topic"), "work_id", "cited_by_count")


def fetch_seeds(universe: DataFrame, per_topic: int = PER_TOPIC) -> DataFrame:
    """(topic, work_id): each topic's most cited works; ties go to the smaller id. ``universe`` has topic, work_id, cited_by_count."""
    order = Window.partitionBy("topic").orderBy(F.desc("cited_by_count"), "work_id")
    return universe.select("topic", "work_id", "cited_by_count").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_topic).select("topic", "work_id")


def resolve_ids(universe: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of known ids; unknown ones are absent."""
    return universe.join(ids.select("work_id").distinct(), "work_id", "left_semi")


def fetch_citing(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(topic, work_id): works that cite a seed, each once a topic."""
    s = seeds.select("topic", F.col("work_id").alias("cited_work_id"))
    return edges.join(s, "cited_work_id").select("topic", F.col("citing_work_id").alias("work_id")).distinct()


def snowball(universe: DataFrame, edges: DataFrame, per_topic: int = PER_TOPIC) -> DataFrame:
    """(topic, work_id, hop): seeds, the works they cite and those that cite them; the first hop counts.

    ``universe`` (topic, work_id, cited_by_count) is what the source knows,
    ``edges`` are (citing_work_id, cited_work_id) among all ids. Joins are on
    work ids; seeds are at most ``per_topic`` a topic.
    """
    seeds = fetch_seeds(universe, per_topic)
    known = universe.select("work_id").distinct()
    out = edges.join(seeds.withColumnRenamed("work_id", "citing_work_id"), "citing_work_id").select("topic", F.col("cited_work_id").alias("work_id")).distinct()
    cited = out.join(seeds, ["topic", "work_id"], "left_anti").join(known, "work_id", "left_semi").select("topic", "work_id")
    citing = fetch_citing(edges, seeds).join(known, "work_id", "left_semi").select("topic", "work_id")
    tagged = seeds.withColumn("hop", F.lit("seed")).union(cited.withColumn("hop", F.lit("cited"))).union(citing.withColumn("hop", F.lit("citing")))
    return tagged.groupBy("topic", "work_id").agg(F.min_by("hop", hop_rank(F.col("hop"))).alias("hop"))


def harvest(records: DataFrame, per_topic: int = PER_TOPIC) -> DataFrame:
    """Full records of the snowball over a table of work records with ``_topic``, tagged with _seed_topic and _hop."""
    ids = records.withColumn("work_id", short_id("id"))
    universe = ids.select(F.col("_topic").alias("topic"), "work_id", "cited_by_count")
    edges = ids.select(F.col("work_id").alias("citing_work_id"), F.explode("referenced_works").alias("r")).select("citing_work_id", short_id("r").alias("cited_work_id"))
    tags = snowball(universe, edges, per_topic).select("work_id", F.col("topic").alias("_seed_topic"), F.col("hop").alias("_hop"))
    return ids.drop("_topic", "_seed_topic", "_hop").join(tags, "work_id").drop("work_id")


def harvest_summary(tagged: DataFrame) -> DataFrame:
    """(topic, works) with the total before works are merged across topics under a null topic."""
    return tagged.rollup("topic").agg(F.count("*").alias("works"))
