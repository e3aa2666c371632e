"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, broadcast_if_small, materialize, table
from citeloom.llm.components import connected_components
from citeloom.shipping import ship_package

BITS = 2  # fingerprints link at this many differing bits or fewer
MIN_BYTES = 8 - BITS  # so they share at least this many positional bytes
WIDTH = 3
SEED = 42
#: Posting lists up to this length are paired; the fingerprints of longer ones take the exact way by neighbours.
LIST_LIMIT = 16
_PIECE = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer."""
    from xxhash import xxh64_digest

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < WIDTH:
        words = [b" ".join(words)]
        ends = [len(words[0])]
        starts = [0]
        joined = words[0]
    else:
        joined = b" ".join(words)
        after = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *after[: len(words) - WIDTH]]
        ends = [x - 1 for x in after[WIDTH - 1 :]]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _PIECE):
        digests = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _PIECE], ends[at : at + _PIECE], strict=True)])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, type=pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _mask(places: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in places)
    return m - (1 << 64) if m >> 63 else m


#: The posting lists: four positional bytes each, at the places whose numbers have the XOR 0. Any three places are in
#: exactly one of these 14 sets, so the lists two fingerprints share tell how many positional bytes they share: 7 lists
#: for 7 bytes, 3 for 6, 1 for 5, at most 1 for fewer.
PLACES = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
MASKS = [_mask(c) for c in PLACES]
#: What a pair with the least number of equal bytes has in common, whichever bytes differ.
MIN_LISTS = min(sum(not set(c) & set(differing) for c in PLACES) for differing in combinations(range(8), 8 - MIN_BYTES))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as the links among ``nodes`` (fp, rep), fp distinct.

    The inverted index has a list for each value of each set of four
    positional bytes (a single byte has 256 values only, so its lists would
    grow with the corpus and their pairs with its square). Members of a list
    are paired, the lists that a pair shares are tallied, pairs with MIN_LISTS
    or more, which is to say MIN_BYTES equal bytes or more, are retained and
    verified bit by bit.

    Lists of more than LIST_LIMIT fingerprints are not paired. A pair that
    shares such a list has both members in it; for these members there is an
    exact way without pairs: two fingerprints link if and only if one of their
    neighbours at up to one flipped bit is shared, and a shared neighbour has
    65 owners at most. A pair that shares no such list is tallied in full.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(MASKS)])
    postings = nodes.select("fp", "rep", F.inline(keys))
    sizes = postings.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    live = materialize(postings.join(sizes, ["k", "key"]), "postings")
    short = live.where(F.col("n") <= LIST_LIMIT)
    left = short.select("k", "key", F.col("fp").alias("fa"), F.col("rep").alias("a"))
    right = short.select("k", "key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    tally = left.join(right, ["k", "key"]).where("a < b").groupBy("a", "b", "fa", "fb").agg(F.count("*").alias("lists"))
    pairs = tally.where(F.col("lists") >= MIN_LISTS).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= BITS).select("a", "b")
    hot = live.where(F.col("n") > LIST_LIMIT).select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    near = hot.select("rep", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    owners = near.groupBy("mid").agg(F.collect_list("rep").alias("r")).where(F.size("r") > 1)
    stars = owners.select(F.explode("r").alias("a"), F.array_min("r").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Only A-Z are lower-cased; words are runs without ASCII white space;
    shingles have three words (the whole sequence if there are fewer).
    A null, empty or blank text has fingerprint zero and links like any other.
    Equal texts have equal fingerprints, so each distinct fingerprint is one
    node and copies are never paired. A very long text is hashed whole, in
    pieces of bounded size. A bit set in exactly half the shingles is 0; of
    equal fingerprints and of a component the smallest doc_id speaks. Repeated
    rows are each returned; rows with a null doc_id come back with the
    component of their fingerprint, but a fingerprint that only such rows have
    links nothing (its component is null). An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "fp-nodes")
    found = materialize(connected_components(links(nodes)), "fp-components")
    labels = nodes.join(broadcast_if_small(found), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(labels, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class; every column stays.

    Repeated rows of one doc_id count as one document: they go if any of them
    is in a class with a smaller doc_id. Rows with a null doc_id stay. Null,
    empty and blank texts are copies of each other. Very long texts and an
    empty table need no other care; columns of any name pass through.
    """
    gone = materialize(near_duplicate_classes(docs).where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
