"""Exact vector search and the upkeep of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.vectors import cosine, embed
from citeloom.ranks import broadcast_if_small, global_rank
from citeloom.scratch import materialize
from citeloom.shipping import ship_package

#: Query vectors, and rows, scored at once: the matrix of a block and a chunk is what a task holds.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: A task passes on what it has found when it holds results of so many queries.
HELD_QUERIES = 50_000
RESULT = "title publication_year primary_topic_field primary_topic_domain cited_by_count foundational_score is_oa oa_url seed_topic".split()


def paper_filter(papers: DataFrame, field: str | None = None, year_from: int | None = None, open_access_only: bool = False, seed_topic: str | None = None) -> DataFrame:
    """Optional predicates; one that is not given is not in the plan. A null year fails ``year_from``."""
    rules: list[Column] = []
    if field is not None:
        rules.append(F.col("primary_topic_field") == field)
    if year_from is not None:
        rules.append(F.col("publication_year") >= year_from)
    if open_access_only:
        rules.append(F.col("is_oa"))
    if seed_topic is not None:
        rules.append(F.col("seed_topic") == seed_topic)
    for r in rules:
        papers = papers.where(r)
    return papers


def clamp_top_k(top_k: int) -> int:
    return max(1, min(50, int(top_k)))


def search(embeddings: DataFrame, papers: DataFrame, query: list[float], top_k: int = 10, **filters) -> DataFrame:
    """The ``top_k`` works by their best chunk, with eleven columns; ties go to the smaller id.

    Filters act before the best chunk is taken, so a search never comes up
    short because of them.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    p = paper_filter(papers, **filters).select("work_id", *RESULT)
    best = embeddings.select("work_id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity")).groupBy("work_id").agg(F.max("similarity").alias("similarity"))
    return p.join(best, "work_id").orderBy(F.desc_nulls_last("similarity"), "work_id").limit(top_k)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in chunks of vectors of one length: (d, works, vectors), the vectors as one binary value."""
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            part, held = b.slice(at, ROW_BLOCK), {}
            for work, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if v and None not in v:
                    held.setdefault(len(v), []).append((work, v))
            for d, rows in held.items():
                vectors = np.array([v for _, v in rows], dtype=np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([[w for w, _ in rows]], pa.list_(pa.string())), pa.array([vectors], pa.binary())], names=["d", "works", "vectors"])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _packed(by: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of queries as one binary value of unit vectors each, so that a task decodes nothing for a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                units = _unit(np.array([q["vector"] for q in row["queries"]], dtype=np.float64))
                columns = [pa.array([row[by]], pa.int32()), pa.array([[q["query_id"] for q in row["queries"]]], pa.list_(pa.int64())), pa.array([units.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[by, "ids", "units"])

    return run


def usable_queries(queries: DataFrame) -> DataFrame:
    """(query_id, vector, d): queries whose vector is neither null nor empty nor holds a null."""
    known = queries.select("query_id", "vector").where("vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
    return known.withColumn("d", F.size("vector"))


def query_blocks(queries: DataFrame, by: str) -> DataFrame:
    """(by, ids, units): ``queries`` (query_id, vector, by) in blocks of QUERY_BLOCK with one value of ``by``."""
    placed = global_rank(queries, [by, "query_id"], "queries", "place")
    blocks = placed.groupBy(by, F.floor(F.col("place") / QUERY_BLOCK).alias("b")).agg(F.collect_list(F.struct("query_id", "vector")).alias("queries"))
    return materialize(blocks.mapInArrow(_packed(by), f"{by} int, ids array<long>, units binary"), "query-blocks")


def meet(chunks: DataFrame, blocks: DataFrame, by: str, spread: str) -> DataFrame:
    """Every chunk with every block of its ``by``. Blocks are broadcast if they are small, else copied to the parts that chunks are dealt to by ``spread``."""
    few = broadcast_if_small(blocks)
    if few is not blocks:
        return chunks.join(few, by)
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return chunks.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(parts))).join(copies, [by, "part"])


def _scorer(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (ids, units, works, vectors) to the best k works of each query that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            out = [(q, w, s) for q, own in top.items() for w, s in own.items()]
            columns = list(zip(*out, strict=True)) or [()] * 3
            top.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["query_id", "work_id", "similarity"])

        top: dict[int, dict[str, float]] = {}
        for b in batches:
            for i in range(b.num_rows):
                ids, works = b.column(0)[i].values.to_pylist(), b.column(2)[i].values.to_pylist()
                units = np.frombuffer(b.column(1)[i].as_buffer()).reshape(len(ids), -1)
                score = units @ _unit(np.frombuffer(b.column(3)[i].as_buffer()).reshape(len(works), -1)).T
                for q, line in zip(ids, score, strict=True):
                    own = top.setdefault(q, {})
                    floor = min(own.values()) if len(own) >= k else -2.0
                    hits, seen = np.flatnonzero(line >= floor - 1e-6), set()
                    for j in hits[np.argsort(-line[hits])].tolist():
                        if len(seen) >= k and line[j] < floor - 2e-6:
                            break
                        own[works[j]] = max(own.get(works[j], -2.0), round(float(line[j]), 6))
                        if len(seen) < k:
                            seen.add(works[j])
                            floor = max(floor, float(line[j])) if len(seen) == k else floor
                    if len(own) > k:
                        top[q] = dict(sorted(own.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k])  # null ids first, as Spark sorts
                if len(top) > HELD_QUERIES:
                    yield rows()
        yield rows()

    return run


def best_works(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, work_id, similarity, rank): the best k works of each query by their best chunk; ties go to the smaller id."""
    best = scored.groupBy("query_id", "work_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "work_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, work_id, similarity, rank): for each query (query_id, vector) the best k works.

    Queries are a table of blocks of QUERY_BLOCK, rows a table of chunks; a
    chunk meets each block in the executors, one matrix product for each pair.
    A task keeps its best k works of each query, so what is shuffled is k rows
    for each query and task. Null vectors, and vectors of another length than
    the query's, are like nothing and not found; a null query finds nothing.
    """
    ship_package(embeddings.sparkSession)
    chunks = embeddings.select("work_id", "embedding").mapInArrow(_chunks, "d int, works array<string>, vectors binary")
    pairs = meet(chunks, query_blocks(usable_queries(queries), "d"), "d", "vectors").select("ids", "units", "works", "vectors")
    return best_works(pairs.mapInArrow(_scorer(k), "query_id long, work_id string, similarity double"), k)


def search_many(embeddings: DataFrame, papers: DataFrame, queries: DataFrame, top_k: int = 10, **filters) -> DataFrame:
    """``search`` for each of many query vectors (query_id, vector): query_id, rank and the eleven columns."""
    p = paper_filter(papers, **filters).select("work_id", *RESULT)
    found = knn(embeddings.join(p.select("work_id"), "work_id", "left_semi"), queries, top_k)
    return found.join(p, "work_id").select("query_id", "rank", "work_id", *RESULT, "similarity")


def similar_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the cosine similarity to pairs (a, b) of keys of ``vectors`` (id, embedding)."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(vectors.select(F.col("id").alias(side), F.col("embedding").alias(f"_{side}")), side)
    return out.select("a", "b", F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("similarity"))


def chunk_papers(papers: DataFrame, text: str = "narrative_abstract", size: int = 1500, overlap: int = 100) -> DataFrame:
    """(embedding_id, work_id, chunk_index, chunk_text); the index counts the pieces that are left."""
    c = papers.select("work_id", F.posexplode(tx.chunks(F.col(text), size, overlap)).alias("chunk_index", "chunk_text"))
    return c.select(F.concat_ws(":", "work_id", F.col("chunk_index").cast("string")).alias("embedding_id"), "work_id", "chunk_index", "chunk_text")


def unembedded(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """The queue of works with a text and no embedding; with ``limit``, its first works by synced_at, nulls first, then id."""
    queue = papers.where("embedded_at IS NULL AND narrative_abstract IS NOT NULL")
    return queue if limit is None else queue.orderBy(F.asc_nulls_first("synced_at"), "work_id").limit(limit)


def refresh_embeddings(papers: DataFrame, embeddings: DataFrame, make: Callable[[], Callable], now: Column) -> tuple[DataFrame, DataFrame]:
    """(embeddings, papers) with the queue drained: its works' chunks are replaced, and all its works marked, even those without a chunk."""
    ship_package(papers.sparkSession)
    due = unembedded(papers).select("work_id", "narrative_abstract")
    new = embed(chunk_papers(due), "chunk_text", make)
    kept = embeddings.join(due.select("work_id"), "work_id", "left_anti").select(*new.columns)
    marked = papers.withColumn("embedded_at", F.when(F.col("embedded_at").isNull() & F.col("narrative_abstract").isNotNull(), now).otherwise(F.col("embedded_at")))
    return kept.unionByName(new), marked
