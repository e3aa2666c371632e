"""Benchmark decontamination by size-partitioned MinHash containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import broadcast_if_small, let, materialize, table

WIDTH = 5
CONTAINMENT = 0.8
#: Items with fewer words are not looked for: as phrases they would be in clean documents too. ``short_items`` shows them.
LEAST_WORDS = WIDTH
WORDS = r"[\p{L}\p{M}\p{N}]+"
#: The filter that spares the join what no item holds has this many bits a shingle, two of them set, up to this many 64-bit words.
FILTER_BITS, FILTER_WORDS = 16, 1 << 17


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _shingles(w: Column, width: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<h, s>>: hash and text of each shingle of the words ``w`` whose hash passes ``keep``; null if there is none."""
    places = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width))

    def hashed(codes: Column) -> Column:
        found = F.transform(places, lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get(codes, i + j) for j in range(width)]).alias("h")))
        return F.filter(found, lambda x: keep(x["h"])) if keep else found

    def spelt(x: Column) -> Column:
        return F.struct(x["h"].alias("h"), F.concat_ws(" ", *[F.get(w, x["i"] + j) for j in range(width)]).alias("s"))

    return F.transform(let(F.transform(w, lambda x: F.xxhash64(x)), hashed), spelt)


def _widths(least_words: int, width: int) -> range:
    if not 1 <= least_words:
        raise ValueError("least_words must be positive")
    return range(min(least_words, width), width + 1)


def short_items(items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, n_words) of the items that are not looked for; those without a word are among them."""
    return items.select("item_id", F.size(words(F.coalesce(F.col("text"), F.lit("")))).alias("n_words")).where(F.col("n_words") < least_words)


def item_shingles(items: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, width, u, n_item, shingles): the distinct shingles of each item of ``least_words`` words or more, u their hash.

    Items with fewer words than ``width`` are one shingle of all their words.
    """
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= least_words)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    out = F.lit(None).cast("array<struct<h:bigint,s:string>>")
    for k in _widths(least_words, width):
        out = F.when(F.col("width") == k, F.array_distinct(_shingles(F.col("w"), k))).otherwise(out)
    made = w.select("item_id", "width", out.alias("shingles"))
    made = made.select("item_id", "width", F.xxhash64("shingles").alias("u"), F.size("shingles").alias("n_item"), "shingles")
    return made.dropDuplicates(["item_id", "u"])


def signatures(shingled: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(item_id, u, width, least, h): the smallest shingle hashes of each item, as many as its size class asks for.

    Items are partitioned by the power of two of their size. A document that
    holds the share ``threshold`` of an item lacks at most the share
    1 - ``threshold`` of its shingles, so one of the smallest
    floor((1 - threshold) * size) + 1 hashes is in it: with this many minima,
    taken for the upper end of the size class, the search loses nothing.
    ``least`` is what a document must have at least to hold any item of the
    class; smaller ones are not probed against it.
    """
    lower = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item").cast("double"))))
    minima = F.least(F.floor((2 * lower - 1) * (1 - threshold) + 1e-9) + 1, F.col("n_item")).cast("int")
    hashes = F.array_sort(F.transform("shingles", lambda x: x["h"]))
    return shingled.select("item_id", "u", "width", F.ceil(lower * threshold - 1e-9).cast("int").alias("least"), F.explode(F.slice(hashes, F.lit(1), minima)).alias("h"))


def _bits(h: Column, mask: int) -> list[tuple[Column, Column]]:
    """(word, bit) twice, from different parts of the hash."""
    return [(F.shiftrightunsigned(h, at).bitwiseAND(F.lit(mask)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(63)).cast("int"))) for at, bit in ((0, 40), (20, 46))]


def shingle_filter(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test that every hash of ``hashes`` (h) passes, and of others about one in 70.

    The driver gets one bitmap, of at most FILTER_WORDS words; for more
    hashes than it is made for, more others pass, and nothing is lost.
    """
    n = hashes.count()
    size = 64
    while size * 64 < n * FILTER_BITS and size < FILTER_WORDS:
        size *= 2
    places = F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _bits(F.col("h"), size - 1)])
    found = hashes.select(F.inline(places)).groupBy("w").agg(F.bit_or("b").alias("b")).collect()  # a row a word
    bitmap = [0] * size
    for r in found:
        bitmap[r.w] = r.b
    known = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def passes(h: Column) -> Column:
        (w1, b1), (w2, b2) = _bits(h, size - 1)
        return (F.get(known, w1).bitwiseAND(b1) != 0) & (F.get(known, w2).bitwiseAND(b2) != 0)

    return passes


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that holds ``threshold`` of an item.

    Shingles have ``width`` words. Each document is taken apart once, and
    keeps only the shingles that some item may have; candidates come from the
    items' MinHash signatures, class by class of their size; they are verified
    by joining the shingles themselves, which takes a row for each shingle of
    a candidate, however long the document is or however many items it holds.

    Items of fewer than ``least_words`` words are not looked for (with
    ``least_words`` below ``width``, those with fewer words than ``width`` are
    one shingle). Null or empty texts on either side match nothing; a very long
    text is one row and is read whole; repeated shingles count once, and so do
    repeated documents or items with one id (of differing texts the largest
    containment, of two equal ones the larger item); a share of exactly
    ``threshold`` is contained; rows with a null id match nothing; empty tables
    give no rows; other columns, whatever their names, are not read.
    """
    item = F.col("item_id")
    shingled = materialize(item_shingles(items.where(item.isNotNull()), width, least_words), "bench-shingles")
    signature = materialize(signatures(shingled, threshold), "bench-signatures")
    passes = shingle_filter(shingled.select(F.explode("shingles.h").alias("h")))

    def parts(w: Column) -> Column:
        def of(k: int) -> Column:
            return F.transform(_shingles(w, k, passes), lambda x: F.struct(F.lit(k).alias("width"), x["h"].alias("h"), x["s"].alias("s")))

        none = F.array().cast("array<struct<width:int,h:bigint,s:string>>")
        return F.struct(F.size(w).alias("n_words"), F.array_distinct(F.concat(*[F.coalesce(of(k), none) for k in _widths(least_words, width)])).alias("found"))

    texts = docs.select("doc_id", F.xxhash64("text").alias("v"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    taken = texts.select("doc_id", "v", let(words(F.col("text")), parts).alias("p")).where("size(p.found) > 0")
    taken = materialize(taken.select("doc_id", "v", "p.n_words", "p.found"), "bench-found")
    probes = taken.select("doc_id", "v", "n_words", F.inline("found"))
    hits = probes.drop("s").join(broadcast_if_small(signature), ["width", "h"]).where(F.col("n_words") - F.col("width") + 1 >= F.col("least"))
    found = materialize(hits.select("doc_id", "v", "item_id", "u").distinct(), "bench-candidates")
    wanted = found.join(broadcast_if_small(shingled), ["item_id", "u"]).select("doc_id", "v", "item_id", "u", "n_item", "width", F.explode("shingles.s").alias("s"))
    shared = probes.select("doc_id", "v", "width", "s").distinct().join(wanted, ["doc_id", "v", "width", "s"]).groupBy("doc_id", "v", "item_id", "u", "n_item").agg(F.count("*").cast("int").alias("n_shared"))
    verified = shared.where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    out = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("m"))
    return out.select("doc_id", "item_id", "m.n_shared", "m.n_item", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Drops the documents that hold ``threshold`` of an item; every column stays.

    Cases are those of ``contaminated``: documents with a null id, a null or an
    empty text stay; repeated rows of one id share their fate; items of fewer
    than ``least_words`` words, null and repeated ones drop nothing more; very
    long texts are read whole; without items, or on an empty table, all rows
    stay; columns of any name pass through.
    """
    bad = materialize(contaminated(docs, items, threshold, least_words=least_words).select("doc_id").distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad), "doc_id", "left_anti").select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same pairs by joining all shingles, without signatures.
OP3_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark
), iwk AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) >= 5
), ish AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM iwk)
), n AS (
  SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id
), dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
), dsh AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM iwk))
), hit AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM dsh JOIN ish USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item,
       n_shared / n_item AS containment
FROM hit JOIN n USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9
"""
