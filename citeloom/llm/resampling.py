"""Quality selection by importance resampling over hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, broadcast_if_small, global_rank, materialize, table
from citeloom.shipping import ship_package

BUCKETS = 1 << 14
#: Documents that the target model is fitted on, at most about.
TARGET_DOCS = 100_000
SMOOTHING = 0.5
SEED = 11
_PIECE = 1 << 17
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _buckets(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    h = np.fromiter((ids[w] for w in words), dtype=np.uint64, count=len(words))
    one = (h + np.uint64(1)) * _MULT
    two = ((one[:-1] ^ (one[:-1] >> np.uint64(31))) + h[1:]) * _MULT
    return (np.concatenate([one, two]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features(text: bytes | None, ids: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The n-gram buckets of a whole text, lower-cased in A-Z, in pieces that overlap by a word."""
    words = text.lower().split() if text else []
    for at in range(0, len(words), _PIECE):
        piece = _buckets(words[max(at - 1, 0) : at + _PIECE], ids)
        yield piece[1:] if at else piece


class _Ids(dict):
    """CRC of a word, kept for frequent words."""

    def __missing__(self, word: bytes) -> int:
        value = crc32(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, ids = np.zeros((2, BUCKETS), dtype=np.int64), _Ids()
    for b in batches:
        for text, target in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            for f in features(text.as_py(), ids):
                own = np.bincount(f, minlength=BUCKETS)
                counts[0] += own
                if target:
                    counts[1] += own
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) by bucket. The raw model counts all texts, the target model a bounded sample."""
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    total = target_ids.count()
    chosen = target_ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, TARGET_DOCS / max(total, 1)))))
    chosen = materialize(chosen.select("doc_id", F.lit(True).alias("target")), "target-ids")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(broadcast_if_small(chosen), "doc_id", "left").select("text", "target")
    counts = rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    table_ = np.full((2, BUCKETS), SMOOTHING)
    table_[:, counts["bucket"]] += counts[["raw", "target"]].to_numpy().T
    p = table_ / table_.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_features, log_weight) for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, r = _Ids(), shared.value
        for b in batches:
            n, w = [], []
            for text in b.column(1):
                parts = [(len(f), float(r[f].sum())) for f in features(text.as_py(), ids)]
                n.append(sum(x for x, _ in parts))
                w.append(sum(x for _, x in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), pa.array(w, type=pa.float64())], names=["doc_id", "n_features", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, log_weight double")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that the id and the seed decide."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """(doc_id, n_features, log_weight, key, rank, kept) for every row of ``docs``.

    The target are labelled documents of quality 1 that are not toxic; the raw
    model is counted over all texts. key is the log importance weight plus
    Gumbel noise; the ceil(share * rows) largest keys are kept, which samples
    that many rows without replacement in proportion to their weights. share
    defaults to the share of quality 1 among the labelled rows (1 without any).
    Null and empty texts have no features and weight 0 (a ratio of 1); very
    long texts count whole, in pieces; ties are broken by doc_id, nulls first;
    repeated rows are ranked each; without a target
    every ratio is 1; an empty table gives no rows. Of ``docs``, only doc_id and
    text are read, of ``labels`` doc_id, quality and toxic (nulls: not in the
    target).
    """
    fine = F.coalesce(F.col("quality"), F.lit(0)) == 1
    good = fine & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    n, n_fine, n_good = labels.agg(F.count("*"), F.count_if(fine), F.count_if(good)).first()
    if share is None:
        share = n_fine / n if n_good else 1.0
    ratios = fit(docs, labels.where(good).select("doc_id").distinct()) if n_good else np.zeros(BUCKETS)
    # Written before it is ranged: the sampling of ranges would otherwise score all texts a second time.
    keyed = log_weights(docs, ratios).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id")))
    ranked = global_rank(materialize(keyed, "weights"), [F.desc("key"), F.asc("doc_id")], "resample", "rank")
    k = F.ceil(F.lit(share) * F.lit(ranked.count()) - 1e-9)
    return ranked.select("doc_id", "n_features", "log_weight", "key", "rank", (F.col("rank") < k).alias("kept"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
