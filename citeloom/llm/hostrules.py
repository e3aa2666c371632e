"""Quality rules with verdicts by host."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, broadcast_if_small, materialize, table
from citeloom.shipping import ship_package

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host whose shrunk failure rate is above this fails with all its documents.
HOST_LIMIT = 0.6
_SPACE = bytes([32, *range(9, 14)])
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NOT_WORD = np.zeros(256, dtype=bool)
_NOT_WORD[list(_SPACE)] = True
_NOT_WORD[0x80:0xC0] = True  # continuation bytes are not counted twice
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(_SYMBOLS)] = True


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the list, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids = defaultdict(lambda: len(ids))
    w = np.fromiter((ids[x] for x in words), dtype=np.int64, count=n)
    if len(ids) < 1 << 21:
        _, inverse, count = np.unique((w[:-2] << 42) | (w[1:-1] << 21) | w[2:], return_inverse=True, return_counts=True)
    else:
        _, inverse, count = np.unique(np.stack([w[:-2], w[1:-1], w[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    again = count[inverse.ravel()] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = np.frombuffer(text, dtype=np.uint8)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), int(len(raw) - _NOT_WORD[raw].sum()), int(_IS_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = list(zip(*[measure(t.as_py()) for t in b.column(2)], strict=True)) or [()] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, type=pa.int64()) for c in columns]], names=["doc_id", "host", *_COUNTS])


def rule_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, counts, base_failed) for every row; the host is the source."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_failed): failure rates shrunk with an empirical beta prior.

    The prior's mean is the rate over all documents of known host; its
    strength, 1 at least, comes from the spread of host rates by the method of
    moments; hosts that differ no more than chance has it get the mean. The
    aggregation combines before it shuffles, so a hot host is no group of rows.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("h"), F.sum(F.pow("n_docs", F.lit(2.0))).alias("n2")).first()
    if not total.n:
        return hosts.select("*", F.lit(0.0).alias("rate"), F.lit(False).alias("host_failed"))
    mean = total.k / total.n
    spread = hosts.agg(F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - mean, F.lit(2.0)))).first()[0]
    noise = mean * (1 - mean)
    between = (spread - (total.h - 1) * noise) / max(total.n - total.n2 / total.n, 1e-9)
    strength = max(noise / between - 1, 1.0) if between > 0 else None
    rate = F.lit(mean) if strength is None else (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > limit)


def host_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, host, counts, base_failed, host_rate, kept) for every row of ``docs``.

    kept is false if the document fails a base rule, or if its host fails. A
    null source is no host: only the base rules decide. Null and empty texts
    have no words and fail; very long ones are measured whole. A host whose
    rate is exactly the limit stays. Repeated rows and null ids each count; an
    empty table gives no rows; columns other than doc_id, source and text,
    whatever their names, are not read.
    """
    measured = materialize(rule_failures(docs), "rule-failures")
    hosts = host_verdicts(measured, limit).select("host", F.col("rate").alias("host_rate"), "host_failed")
    out = measured.join(broadcast_if_small(hosts), "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return out.select("doc_id", "host", *_COUNTS, "base_failed", "host_rate", kept.alias("kept"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).drop("host", "host_rate")


#: Counts in SQL; the host verdict by the same moments.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), win AS (
  SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM again, (VALUES (0), (1), (2)) v(k)) GROUP BY r
), ln AS (
  SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.doc_id, d.host, len(w.w) AS n_words,
         length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n, sum(base_failed::INT)::BIGINT AS k FROM f WHERE host IS NOT NULL GROUP BY host
), tot AS (
  SELECT sum(n)::DOUBLE AS n, sum(k) / sum(n) AS mean, count(*) AS h, sum(n::DOUBLE * n) AS n2 FROM h
), sp AS (
  SELECT sum(h.n * (h.k / h.n - tot.mean) ** 2) AS s FROM h, tot
), par AS (
  SELECT mean, (s - (h - 1) * mean * (1 - mean)) / greatest(n - n2 / n, 1e-9) AS b FROM tot, sp
), pri AS (
  SELECT mean, CASE WHEN b > 0 THEN greatest(mean * (1 - mean) / b - 1, 1) END AS a FROM par
), v AS (
  SELECT host, CASE WHEN a IS NULL THEN mean ELSE (k + mean * a) / (n + a) END AS host_rate FROM h, pri
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rate > 0.6, false) AS kept
FROM f LEFT JOIN v USING (host)
"""
