"""The training-data pipeline: five stages over ``documents``, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.common import table
from citeloom.llm.decontamination import decontaminate
from citeloom.llm.langid import keep_accepted
from citeloom.llm.mixing import sample_mix
from citeloom.llm.sharding import hilbert_shards
from citeloom.llm.simhash import drop_near_duplicates
from citeloom.scratch import drop_scratch, scratch_path, scratch_scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go; the models learn from the labelled rows of ``docs``.

    A null or empty text, or one without a letter, is rejected; a null id,
    lang or source is no reason to go. Very long texts are scored whole.
    Repeated rows share their fate, ties between languages do not matter to
    it. An empty table stays empty; columns of any name pass through.
    """
    return keep_accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Null, empty and blank texts are copies of each other; rows with a null id
    stay; repeated rows of one id are one document. Very long texts are hashed
    whole. An empty table stays empty; columns of any name pass through.
    """
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % or more of a benchmark item of five words or more go.

    Null and empty texts hold nothing and stay, and so do rows with a null id;
    repeated rows share their fate; a share of exactly 80 % counts. Very long
    texts are read whole. An empty table, or one without items, is returned as
    it is; columns of any name pass through.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of about 70 % of all tokens stays, drawn with probabilities raked to source, language and topic shares.

    The shares are those that a sample of this size can have when nothing is
    taken twice, so the sample has them in expectation.

    Null and blank texts have no tokens and go; null metadata are a category
    of their own; repeated rows share their fate, as the id decides. Very long
    texts count whole. An empty table stays empty; columns of any name pass
    through.
    """
    return sample_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's place: doc_id, metadata, shard and slot.

    Every row gets one, whatever is null in it; copies are neighbours, and
    repeated rows lie side by side in any order. Very long texts count by
    their size. An empty table gives no rows; other columns are not read.
    """
    return hilbert_shards(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: The language and fingerprint stages have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is removed once its result is written, and that once it is used."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
        if last:
            drop_scratch(spark, last)
        last = out
    return docs
