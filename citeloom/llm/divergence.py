"""How the sources of a language differ in their words: an index built in blocks, merged in shards, read once."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, broadcast_if_small, materialize, table
from citeloom.shipping import ship_package

MIN_DOCS = 30
SMOOTH, UNIT = 5, 1_000_000_000
TOP_TERMS = 50
#: A block is spilled as a sorted run once it has this many postings (some 100 bytes each while it is sorted) ...
BLOCK_POSTINGS = 1_000_000
#: ... or once its terms have this many bytes.
BLOCK_BYTES = 64 << 20
#: Runs go to the merge in chunks of at most this many postings and about this many bytes; a merge holds one chunk of each run.
CHUNK, CHUNK_BYTES = 2048, 1 << 20
#: So many runs of a shard are merged at once; more are merged in several passes.
FAN_IN = 64
#: Texts are taken apart in pieces of about this many bytes, and short texts together.
_PIECE = 4 << 20

#: Bytes of terms stay, A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


#: A term of a group with its occurrences and documents: (key, n, docs).
Posting = tuple[bytes, int, int]


def _escaped(name: bytes) -> bytes:
    return name.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def _plain(name: bytes) -> str:
    return name.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1").decode()


def pieces_of(text: bytes) -> Iterator[bytes]:
    """A UTF-8 text in pieces of bounded size, cut between terms, with a space for every byte that no term has."""
    at = 0
    while at < len(text):
        piece = text[at : at + _PIECE].translate(_TERM_BYTES)
        while piece[-1] != 32 and at + len(piece) < len(text):  # go on to the end of the last term
            more = text[at + len(piece) : at + len(piece) + 4096].translate(_TERM_BYTES)
            cut = more.find(b" ")
            piece += more if cut < 0 else more[: cut + 1]
        at += len(piece)
        yield piece


def _added_up(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each of ``values`` over them."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([key[:1] >= 0, key[1:] != key[:-1]]))
    return key[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def chunked(postings: Iterator[tuple[int, Posting]]) -> Iterator[tuple[int, list[Posting]]]:
    """Cuts (shard, posting) into chunks of one shard and bounded size."""
    held: list[Posting] = []
    at, size = None, 0
    for shard, p in postings:
        if held and (shard != at or len(held) == CHUNK or size >= CHUNK_BYTES):
            yield at, held
            held, size = [], 0
        at = shard
        held.append(p)
        size += len(p[0])
    if held:
        yield at, held


class Block:
    """Postings in memory: of each document its distinct terms and how often they occur."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.group_of: list[int] = []
        self.postings = self.bytes = 0
        self._terms: list[pa.Array] = []
        self._codes: list[np.ndarray] = []
        self._docs: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._waiting: list[tuple[int, bytes]] = []
        self._waiting_bytes = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        doc = len(self.group_of)
        self.group_of.append(self.groups.setdefault((lang, source), len(self.groups)))
        for piece in pieces_of(text):
            self._waiting.append((doc, piece))
            self._waiting_bytes += len(piece)
            if self._waiting_bytes >= _PIECE:
                self.take()

    def take(self) -> None:
        """Turns the pieces that wait into postings."""
        if not self._waiting:
            return
        docs, pieces = zip(*self._waiting, strict=True)
        self._waiting, self._waiting_bytes = [], 0
        lists = pc.split_pattern(pa.array(pieces, pa.binary()), b" ")
        terms, parents = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(terms), 0)
        found = terms.filter(real).dictionary_encode()
        at = parents.filter(real).to_numpy()
        key, n = np.unique(found.indices.to_numpy().astype(np.int64) * len(docs) + at, return_counts=True)
        self._codes.append(key // len(docs) + sum(map(len, self._terms)))
        self._docs.append(np.array(docs, dtype=np.int64)[key % len(docs)])
        self._counts.append(n)
        self._terms.append(found.dictionary)
        self.postings += len(key)
        self.bytes += found.dictionary.nbytes

    def run(self, shards: int, run: int) -> Iterator[pa.RecordBatch]:
        """The chunks of the block in the order of shards and keys; forgets them.

        A key is term, language and source, in this order, divided by a byte
        that none of them holds, so that it sorts as one string of bytes.
        """
        self.take()
        if self.postings:
            every = pa.concat_arrays(self._terms).dictionary_encode()
            terms, code_of = every.dictionary, every.indices.to_numpy().astype(np.int64)
            codes, docs, counts = code_of[np.concatenate(self._codes)], np.concatenate(self._docs), np.concatenate(self._counts)
            key, counts = _added_up(codes * len(self.group_of) + docs, counts)  # a long text's pieces are one document
            codes, docs = np.divmod(key, len(self.group_of))
            group = np.array(self.group_of, dtype=np.int64)[docs]
            key, counts, docs = _added_up(codes * len(self.groups) + group, counts, np.ones(len(group), dtype=np.int64))
            codes, group = np.divmod(key, len(self.groups))
            labels = [b"\0" + _escaped(lang) + b"\0" + _escaped(source) for lang, source in self.groups]
            shard = np.array([crc32(t) % shards for t in terms.to_pylist()], dtype=np.int32)[codes]
            order = np.lexsort((_ranks(pa.array(labels, pa.binary()))[group], _ranks(terms)[codes], shard))
            yield from _chunk_batches(shard[order], run, terms.take(pa.array(codes[order])), labels, group[order], counts[order], docs[order])
        self.__init__()


def _ranks(values: pa.Array) -> np.ndarray:
    out = np.empty(len(values), dtype=np.int64)
    out[pc.sort_indices(values).to_numpy()] = np.arange(len(values))
    return out


_CHUNKS = "shard int, run long, first binary, terms binary, labels binary, label_of binary, counts binary, docs binary"
_CHUNK_NAMES = [c.split()[0] for c in _CHUNKS.split(", ")]


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest of them needs."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def _wide(data: bytes, n: int) -> list[int]:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}").tolist()


def _chunk_batches(shard: np.ndarray, run: int, terms: pa.Array, labels: list[bytes], label_of: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted postings, cut into chunks of one shard and bounded size.

    A chunk is a few binary values: its terms, divided by spaces, and numbers
    of one or two bytes mostly, so that runs are small on disk and on the wire.
    """
    size = np.cumsum(pc.binary_length(terms).to_numpy().astype(np.int64))
    ends = np.flatnonzero(np.concatenate([shard[1:] != shard[:-1], [True]])) + 1
    start = 0
    for end in ends.tolist():
        while start < end:
            full = int(np.searchsorted(size, (size[start - 1] if start else 0) + CHUNK_BYTES))
            stop = min(end, start + CHUNK, max(full, start + 1))
            words = terms[start:stop].to_pylist()
            used, own = np.unique(label_of[start:stop], return_inverse=True)
            names = [labels[i] for i in used]
            values = [words[0] + names[own[0]], b" ".join(words), b"".join(names), *map(_narrow, (own, counts[start:stop], docs[start:stop]))]
            columns = [pa.array([shard[start]], pa.int32()), pa.array([run], pa.int64()), *[pa.array([v], pa.binary()) for v in values]]
            yield pa.RecordBatch.from_arrays(columns, names=_CHUNK_NAMES)
            start = stop


def _invert(batches: Iterator[pa.RecordBatch], shards: int, block_postings: int) -> Iterator[pa.RecordBatch]:
    """Fills blocks and spills them as sorted runs; the runs of a task are numbered from 0."""
    block, run = Block(), 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            block.add(lang, source, text)
            if block.postings >= block_postings or block.bytes >= BLOCK_BYTES:
                yield from block.run(shards, run)
                run += 1
    yield from block.run(shards, run)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, Iterator[Posting]]]:
    for b in batches:
        for row in b.to_pylist():
            words, names = row["terms"].split(b" "), row["labels"].split(b"\0")
            labels = [b"\0" + a + b"\0" + b for a, b in zip(names[1::2], names[2::2], strict=True)]
            n = len(words)
            keys = [w + labels[i] for w, i in zip(words, _wide(row["label_of"], n), strict=True)]
            yield row["shard"], row["first"], zip(keys, _wide(row["counts"], n), _wide(row["docs"], n), strict=True)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Posting]]:
    """(shard, posting) in order, equal keys of all runs added up, from chunks in the order of (shard, first key).

    A heap holds the next posting of every chunk that is open. A chunk is
    opened when the heap has nothing smaller than its first key, so of each
    run one chunk is open at a time.
    """
    heap: list[tuple[Posting, int, Iterator[Posting]]] = []
    shard = key = None
    n = docs = number = 0
    chunks = _chunks(batches)
    chunk = next(chunks, None)
    while chunk or heap:
        here, first = (chunk[0], chunk[1]) if chunk else (None, None)
        while heap and (here != shard or heap[0][0][0] < first):
            p, i, rest = heap[0]
            if p[0] == key:
                n += p[1]
                docs += p[2]
            else:
                if key is not None:
                    yield shard, (key, n, docs)
                key, n, docs = p
            after = next(rest, None)
            if after is None:
                heappop(heap)
            else:
                heapreplace(heap, (after, i, rest))
        if chunk:
            if here != shard:
                if key is not None:
                    yield shard, (key, n, docs)
                shard, key = here, None
            heappush(heap, (next(chunk[2]), number, chunk[2]))
            number += 1
            chunk = next(chunks, None)
    if key is not None:
        yield shard, (key, n, docs)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each shard to one; shards of several groups of runs have numbers of their own."""
    for shard, chunk in chunked(merged(batches)):
        keys, counts, docs = zip(*chunk, strict=True)
        parts = [k.partition(b"\0") for k in keys]
        labels: dict[bytes, int] = {}
        label_of = np.array([labels.setdefault(b"\0" + rest, len(labels)) for _, _, rest in parts])
        yield from _chunk_batches(np.full(len(keys), shard), 0, pa.array([t for t, _, _ in parts], pa.binary()), list(labels), label_of, np.array(counts), np.array(docs))


def _frequencies(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Terms in enough documents of their language, one row each with the counts of its sources."""
    names = ["lang", "term", "sources", "counts"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for (_, term_lang), group in groupby(merged(batches), lambda x: (x[0], x[1][0][: x[1][0].rindex(b"\0")])):
        postings = [p for _, p in group]
        if sum(p[2] for p in postings) >= min_docs:
            term, lang = term_lang.split(b"\0")
            out.append((_plain(lang), term.decode(), [_plain(p[0][len(term_lang) + 1 :]) for p in postings], [p[1] for p in postings]))
            held += len(postings)
        if held >= 10_000:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _groups_of(docs: DataFrame) -> DataFrame:
    """lang, source and text as strings, nulls empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int | None = None, block_postings: int = BLOCK_POSTINGS, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, sources, counts): the terms in ``min_docs`` documents of a language or more, with their occurrences in each source."""
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _groups_of(docs).select(*[F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")])
    runs = rows.mapInArrow(lambda it: _invert(it, shards, block_postings), _CHUNKS)
    runs = materialize(runs.withColumn("run", F.shiftleft(F.spark_partition_id().cast("long"), 24) + F.col("run")), "term-runs")
    while (n := runs.agg(F.count_distinct("run")).first()[0]) > fan_in:
        groups = -(-n // fan_in)
        numbers = runs.select("run").distinct().withColumn("group", F.floor(F.pmod(F.xxhash64("run"), F.lit(groups))))
        grouped = runs.join(broadcast_if_small(numbers), "run").withColumn("shard", (F.col("group") * shards + F.col("shard")).cast("int")).select(*_CHUNK_NAMES)
        one = grouped.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(_merge_runs, _CHUNKS)
        fewer = one.withColumn("run", F.floor(F.col("shard") / shards)).withColumn("shard", F.col("shard") % shards)
        runs = materialize(fewer.select(*_CHUNK_NAMES), "merged-runs")
    ordered = runs.repartition("shard").sortWithinPartitions("shard", "first")
    return materialize(ordered.mapInArrow(lambda it: _frequencies(it, min_docs), "lang string, term string, sources array<string>, counts array<long>"), "term-frequencies")


def _share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) in whole numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n), wide(total)) + 1


def _pair_sums(batches: Iterator[pa.RecordBatch], groups: dict[str, tuple[list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Corrections of the distances of all pairs of sources, added up over the terms of a task.

    A term that neither source has adds the distance of their floors, so that
    floor counts for all terms; what is streamed are the terms that one or both
    have, each with its difference from the floor's distance.
    """
    floors, slot, total = {}, {}, {}
    for b in batches:
        for row in b.to_pylist():
            lang = row["lang"]
            if lang not in floors:
                names, sums = groups[lang]
                slot[lang] = {s: i for i, s in enumerate(names)}
                floors[lang] = np.array([1 + UNIT * SMOOTH // t for t in sums], dtype=np.int64)
                total[lang] = np.zeros((len(names), len(names)), dtype=np.int64)
            floor, sums = floors[lang], groups[lang][1]
            here = np.array([slot[lang][s] for s in row["sources"]], dtype=np.int64)
            p = np.array([1 + UNIT * (n + SMOOTH) // sums[i] for i, n in zip(here.tolist(), row["counts"], strict=True)], dtype=np.int64)
            every = floor.copy()
            every[here] = p
            change = np.abs(p[:, None] - every) - np.abs(floor[here][:, None] - floor)
            total[lang][here] += change
            absent = np.ones(len(floor), dtype=bool)
            absent[here] = False
            # The rows of sources without the term get their side of the pair.
            total[lang][np.ix_(np.flatnonzero(absent), here)] += change[:, absent].T
    for lang, t in total.items():
        names = groups[lang][0]
        a, b_ = np.nonzero(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b_], pa.string()), pa.array(t[a, b_], pa.int64())],
            names=["lang", "source", "item", "change"],
        )


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, **index: int) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language lie apart, and by which terms.

    Every group (lang, source) gives each kept term of its language the share
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)), and so does the language. Part
    ``pair`` holds, for each other source of the language, the sum of |p - q|
    over all kept terms; part ``term`` the ``top_terms`` terms that the group
    has and uses more than the language does. Shares, sums and ranks are exact;
    ties of values go by the bytes of the item.

    Null text, lang and source are read as empty; groups without terms count.
    Very long texts are read whole, in pieces; a term that stands in a third of
    all documents is one posting of a block. Repeated rows and null ids each
    count as documents. The pairs of a language are as many as the result has
    rows, and all that a task holds beside its chunks. An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    terms = term_frequencies(docs, min_docs, **index)
    found = materialize(_groups_of(docs).select("lang", "source").distinct(), "lang-sources")
    each = terms.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    sums = materialize(each.groupBy("lang", "source").agg(F.sum("n").alias("n")), "group-sums")
    kept = materialize(terms.groupBy("lang").agg(F.count("*").alias("v")), "kept-terms")
    groups = found.join(sums, ["lang", "source"], "left").join(broadcast_if_small(kept), "lang", "left")
    groups = groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = materialize(groups, "groups")

    # Terms by group, against the language.
    langs = sums.groupBy("lang").agg(F.sum("n").alias("all")).join(kept, "lang").select("lang", (F.col("all") + SMOOTH * F.col("v")).alias("lang_total"))
    counted = terms.withColumn("lang_n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).select(
        "lang", F.col("term").alias("item"), "lang_n", F.explode(F.arrays_zip("sources", "counts")).alias("x")
    )
    counted = counted.select("lang", F.col("x.sources").alias("source"), "item", (F.col("x.counts") + SMOOTH).alias("n"), (F.col("lang_n") + SMOOTH).alias("lang_n"))
    shares = counted.join(broadcast_if_small(groups), ["lang", "source"]).join(broadcast_if_small(langs), "lang")
    value = (_share(F.col("n"), F.col("total")) - _share(F.col("lang_n"), F.col("lang_total"))).alias("value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = shares.select("lang", "source", "item", value).where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    # Pairs of sources: the distance of the floors for every term, and the streamed corrections.
    small: dict[str, tuple[list[str], list[int]]] = {}
    for r in groups.where("total > 0").select("lang", "source", "total").toLocalIterator():
        names, totals = small.setdefault(r.lang, ([], []))
        names.append(r.source)
        totals.append(r.total)
    changes = terms.mapInArrow(lambda it: _pair_sums(it, small), "lang string, source string, item string, change long").groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    floor = F.when(F.col("v") > 0, _share(F.lit(SMOOTH), F.col("total")))
    one = groups.select("lang", "source", "v", floor.alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), floor.alias("q"))
    pairs = one.join(broadcast_if_small(other), "lang").where("source <> item").join(changes, ["lang", "source", "item"], "left")
    distance = F.coalesce(F.col("v") * F.abs(F.col("p") - F.col("q")), F.lit(0)) + F.coalesce("change", F.lit(0))
    pairs = pairs.select("lang", "source", "item", distance.alias("value")).withColumn("rank", F.row_number().over(by_value))

    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(top.withColumn("part", F.lit("term")).select(*columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), occ AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), cnt AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM occ GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY lang, term HAVING sum(docs) >= 30
), vl AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), gn AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(cnt.n), 0) AS BIGINT) AS n
  FROM g LEFT JOIN (SELECT cnt.* FROM cnt SEMI JOIN kept USING (lang, term)) cnt ON g.lang = cnt.lang AND g.source = cnt.source GROUP BY g.lang, g.source
), p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(cnt.n, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 5)) // (gn.n + 5 * vl.v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 5)) // (vl.n + 5 * vl.v) AS q
  FROM gn JOIN vl USING (lang) JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = gn.lang AND cnt.source = gn.source AND cnt.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum(abs(s.p - t.p)) AS f FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (
  SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, CAST(rank AS INT) FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term
) WHERE rank <= 50
"""
