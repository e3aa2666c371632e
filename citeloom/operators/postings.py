"""An inverted index of the words of works, and topic search by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.ranks import broadcast_if_small, global_rank
from citeloom.scratch import materialize

#: Folders of an index; a term is in the one that its hash says.
BUCKETS = 64
#: A longer list is placed by several tasks, each of which has a slice of the order of so many works.
SLICE_WORKS = 1 << 22
#: A search reads so many times the works it is to find of each list, and so many times more in each further round.
FIRST_READ, FURTHER = 4, 8


def words_of(works: DataFrame) -> DataFrame:
    """(term, work_id, cited_by_count): each word of a work's title and abstract once, in lower case."""
    text = F.lower(F.concat_ws(" ", "title", "narrative_abstract"))
    terms = F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+"))
    return works.select(F.explode(terms).alias("term"), "work_id", "cited_by_count").where("term <> ''")


def _slice_bounds(works: DataFrame) -> list:
    """Where the order of works goes on to its next SLICE_WORKS works: keys (no citations known, less citations, id)."""
    keys = works.select(*_order())
    if works.count() <= SLICE_WORKS:
        return []
    ranked = global_rank(keys, ["_unknown", "_less", "work_id"], "work-order", "_rank")
    return ranked.where(f"_rank > 0 AND _rank % {SLICE_WORKS} = 0").orderBy("_rank").drop("_rank").collect()


def _order() -> list[Column]:
    return [F.col("cited_by_count").isNull().alias("_unknown"), F.coalesce(-F.col("cited_by_count"), F.lit(0)).cast("long").alias("_less"), F.col("work_id")]


def _slice(bounds: list) -> Column:
    """The slice of the order that a work is in."""
    if not bounds:
        return F.lit(0)
    keys = F.array(*[F.struct(F.lit(b["_unknown"]).alias("_unknown"), F.lit(b["_less"]).cast("long").alias("_less"), F.lit(b["work_id"]).alias("work_id")) for b in bounds])
    return F.size(F.filter(keys, lambda b: b <= F.struct(*_order())))


def build_postings(works: DataFrame, path: str) -> None:
    """Writes the index of ``works`` (work_id, title, narrative_abstract, cited_by_count) under ``path``.

    ``lists`` has a row for each word of a work with its place in the list of
    the word: by citations, most first and nulls last, then by id; ``terms``
    the length of each list. Postings are shuffled once and written once: a
    list comes whole to one task, that of a word with more than SLICE_WORKS
    works in slices of the order of works, whose places go on from those of the
    slices before, which are counted first.
    """
    spark = works.sparkSession
    bounds = _slice_bounds(works)
    postings = words_of(works).withColumn("slice", _slice(bounds))  # without bounds it is a constant, which no row carries
    if bounds:
        counts = materialize(postings.groupBy("term", "slice").agg(F.count("*").alias("n")), "term-slices")
        long = counts.groupBy("term").agg(F.sum("n").alias("works")).where(F.col("works") > SLICE_WORKS).select("term")
        before = Window.partitionBy("term").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.join(broadcast_if_small(materialize(long, "long-lists")), "term").select("term", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
        starts = broadcast_if_small(materialize(starts, "slice-starts"))
        postings = postings.join(starts, ["term", "slice"], "left").withColumn("slice", F.when(F.col("_start").isNull(), 0).otherwise(F.col("slice")))
    # Rows are dealt by one number, which says the folder too, as each further column of a posting costs disk.
    own = ["slice", "_start"] if bounds else []
    subs = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    spot = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)) * subs + F.pmod(F.hash("term", *own[:1]), F.lit(subs))
    dealt = postings.select(spot.cast("int").alias("_spot"), "term", "work_id", "cited_by_count", *own)
    # In the order of words a task's postings take less disk; the filter, which keeps all, keeps Spark from dropping that order.
    dealt = dealt.sortWithinPartitions("_spot", "term").where(F.monotonically_increasing_id() >= 0).repartition("_spot")
    dealt = dealt.withColumn("bucket", F.expr(f"CAST(_spot DIV {subs} AS INT)"))
    order = Window.partitionBy("bucket", "_spot", "term", *own[:1]).orderBy(F.desc_nulls_last("cited_by_count"), "work_id")
    place = (F.row_number().over(order) - 1).cast("long")
    if bounds:
        place += F.coalesce("_start", F.lit(0))
    dealt.select("term", "work_id", "cited_by_count", place.alias("place"), "bucket").write.partitionBy("bucket").parquet(f"{path}/lists")
    spark.read.schema(_LISTS).parquet(f"{path}/lists").groupBy("term").agg(F.count("*").alias("works")).write.parquet(f"{path}/terms")


_LISTS = "term string, work_id string, cited_by_count long, place long, bucket int"


def _lists(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The lists of ``terms`` (term, ...), from the folders that have them."""
    wanted = [r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # BUCKETS at most
    return spark.read.schema(_LISTS).parquet(f"{path}/lists").where(F.col("bucket").isin(wanted))


def find_topics(spark: SparkSession, path: str, topics: DataFrame, per_topic: int | None = None) -> DataFrame:
    """(topic, work_id, cited_by_count): works that have all words of a topic (topic); with ``per_topic``, the most cited of them.

    Topics are a table of any size. The rarest word of a topic gives the
    candidates, and each of them is looked up in the lists of the others, so
    texts are not read. With ``per_topic`` the candidates come by citations, a
    stretch of the list in each round, and topics that have enough drop out;
    ties go to the smaller id. A topic without a word, or with one that no
    work has, finds nothing; topics asked for twice are answered once.
    """
    words = topics.select("topic").distinct().withColumn("term", F.explode(F.array_distinct(F.split(F.lower(F.trim("topic")), r"\s+")))).where("term <> ''")
    known = words.join(spark.read.schema("term string, works long").parquet(f"{path}/terms"), "term", "left")
    asked = known.groupBy("topic").agg(
        F.min(F.struct(F.coalesce("works", F.lit(0)).alias("works"), "term")).alias("rarest"), F.collect_set("term").alias("terms")
    ).where("rarest.works > 0")
    asked = materialize(asked.select("topic", F.col("rarest.term").alias("term"), F.col("rarest.works").alias("works"), "terms"), "topics-asked")
    others = materialize(asked.select("topic", F.explode(F.array_remove("terms", F.col("term"))).alias("other"), F.size("terms").alias("n")), "topics-others")
    lists = _lists(spark, path, asked.select("term").union(others.select("other")))

    def confirmed(candidates: DataFrame) -> DataFrame:
        single = candidates.join(broadcast_if_small(asked.where(F.size("terms") == 1).select("topic")), "topic", "left_semi")
        pairs = candidates.join(broadcast_if_small(others), "topic")
        there = lists.select(F.col("term").alias("other"), "work_id")
        met = pairs.join(there, ["other", "work_id"]).groupBy("topic", "work_id", "cited_by_count", "place", "n").agg(F.count("*").alias("met")).where("met = n - 1")
        return single.select("topic", "work_id", "cited_by_count", "place").unionByName(met.select("topic", "work_id", "cited_by_count", "place"))

    if per_topic is None:
        candidates = lists.join(broadcast_if_small(asked.select("topic", "term")), "term")
        return confirmed(candidates).select("topic", "work_id", "cited_by_count")
    found, open_, start, stop = None, asked.select("topic", "term", "works"), 0, FIRST_READ * per_topic
    while True:
        stretch = lists.where(f"place >= {start} AND place < {stop}").join(broadcast_if_small(open_.select("topic", "term")), "term")
        new = materialize(confirmed(stretch), "topic-hits")
        found = new if found is None else found.unionByName(new)
        enough = found.groupBy("topic").count().where(F.col("count") >= per_topic)
        open_ = materialize(open_.where(F.col("works") > stop).join(enough, "topic", "left_anti"), "topics-open")
        if not open_.limit(1).count():
            break
        start, stop = stop, stop * FURTHER
    order = Window.partitionBy("topic").orderBy("place")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_topic).select("topic", "work_id", "cited_by_count")
