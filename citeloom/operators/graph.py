"""Operators on the citation graph."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import link_explanation
from citeloom.shipping import ship_package

_ROW = "struct<rank:int,work_id:string,prerequisites:array<string>,unlocks:array<string>,in_citation_cycle:boolean>"
_ROW_TYPE = pa.list_(
    pa.struct([("rank", pa.int32()), ("work_id", pa.string()), ("prerequisites", pa.list_(pa.string())), ("unlocks", pa.list_(pa.string())), ("in_citation_cycle", pa.bool_())])
)


def order_works(scores: dict[str, float], pairs: set[tuple[str, str]]) -> list[tuple[str, bool]]:
    """(work, blocked) in reading order: what is cited comes first, the best score first among what is free.

    Works that never become free (on a citation cycle, or behind one) follow
    in the same order of preference and are marked.
    """
    waiting, citing = dict.fromkeys(scores, 0), {w: [] for w in scores}
    for a, b in pairs:
        waiting[a] += 1
        citing[b].append(a)
    free = [(-s, w) for w, s in scores.items() if not waiting[w]]
    heapq.heapify(free)
    out = []
    while free:
        _, w = heapq.heappop(free)
        out.append((w, False))
        for x in citing[w]:
            waiting[x] -= 1
            if not waiting[x]:
                heapq.heappush(free, (-scores[x], x))
    return out + [(w, True) for _, w in sorted((-s, w) for w, s in scores.items() if waiting[w])]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = []
        for members, edges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            scores = {m["work_id"]: m["score"] for m in members}
            pairs = {(e["a"], e["b"]) for e in edges or []}
            before, after = {w: [] for w in scores}, {w: [] for w in scores}
            for x, y in sorted(pairs):
                before[x].append(y)
                after[y].append(x)
            paths.append([(i, w, before[w], after[w], blocked) for i, (w, blocked) in enumerate(order_works(scores, pairs))])
        fields = ["rank", "work_id", "prerequisites", "unlocks", "in_citation_cycle"]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(fields, r, strict=True)) for r in p] for p in paths], type=_ROW_TYPE)], names=["collection_id", "path"])


def induced_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(collection_id, citing_work_id, cited_work_id) with both ends in the collection, each once."""
    citing = members.select("collection_id", F.col("work_id").alias("citing_work_id"))
    cited = members.select(F.col("collection_id").alias("_c"), F.col("work_id").alias("_w")).distinct()
    e = citing.distinct().join(edges.select("citing_work_id", "cited_work_id").distinct(), "citing_work_id")
    return e.join(cited, (F.col("collection_id") == F.col("_c")) & (F.col("cited_work_id") == F.col("_w")), "left_semi").select("collection_id", "citing_work_id", "cited_work_id")


def reading_paths(members: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """(collection_id, rank, work_id, prerequisites, unlocks, in_citation_cycle) for every collection.

    ``members`` has collection_id, work_id, foundational_score (null: 0; of a
    repeated work the largest counts). ``edges`` are (citing_work_id,
    cited_work_id) of the whole corpus, or, with ``strict``, (collection_id,
    citing_work_id, cited_work_id) of which one end outside its collection is
    an error. Collections are ordered in parallel; the order within one is
    sequential by nature, in O((works + edges) log works) on one task.
    """
    m = members.groupBy("collection_id", "work_id").agg(F.max(F.coalesce("foundational_score", F.lit(0.0))).alias("score"))
    if strict:
        inside = m.select(F.col("collection_id").alias("_c"), F.col("work_id").alias("_w"))
        e = edges.distinct()
        for end in ("citing_work_id", "cited_work_id"):
            found = e.join(inside, (F.col("collection_id") == F.col("_c")) & (F.col(end) == F.col("_w")), "left")
            said = F.concat(F.lit("an edge leaves the collection: "), F.col("citing_work_id"), F.lit(" -> "), F.col("cited_work_id"))
            e = found.withColumn("collection_id", F.when(F.col("_w").isNull(), F.raise_error(said).cast(m.schema["collection_id"].dataType)).otherwise(F.col("collection_id"))).drop("_c", "_w")
    else:
        e = induced_edges(m, edges)
    ship_package(members.sparkSession)
    left = m.groupBy("collection_id").agg(F.collect_list(F.struct("work_id", "score")).alias("members"))
    right = e.groupBy("collection_id").agg(F.collect_list(F.struct(F.col("citing_work_id").alias("a"), F.col("cited_work_id").alias("b"))).alias("edges"))
    kind = m.schema["collection_id"].dataType.simpleString()
    paths = left.join(right, "collection_id", "left").select("collection_id", "members", "edges").mapInArrow(_paths, f"collection_id {kind}, path array<{_ROW}>")
    return paths.select("collection_id", F.inline("path"))


def with_layout(path: DataFrame) -> DataFrame:
    """Adds x and y of a grid of up to six columns by rank."""
    sizes = path.groupBy("collection_id").agg(F.count("*").alias("_n"))
    columns = F.greatest(F.lit(1), F.least(F.lit(6), F.ceil(F.sqrt("_n")))).cast("int")
    placed = path.join(sizes, "collection_id").withColumn("_cols", columns)
    return placed.withColumn("x", 50 + F.col("rank") % F.col("_cols") * 130).withColumn("y", 50 + F.floor(F.col("rank") / F.col("_cols")).cast("int") * 70).drop("_n", "_cols")


def prerequisites(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(of_work_id, work_id, title, foundational_score): what each work cites."""
    return _neighbours(edges, papers, "citing_work_id", "cited_work_id")


def unlocks(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(of_work_id, work_id, title, foundational_score): what cites each work."""
    return _neighbours(edges, papers, "cited_work_id", "citing_work_id")


def _neighbours(edges: DataFrame, papers: DataFrame, of: str, other: str) -> DataFrame:
    p = papers.select(F.col("work_id").alias(other), "title", "foundational_score")
    return edges.join(p, other).select(F.col(of).alias("of_work_id"), F.col(other).alias("work_id"), "title", "foundational_score")


def link_status(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds a_cites_b and b_cites_a to pairs (a, b)."""
    e = edges.select(F.col("citing_work_id").alias("_x"), F.col("cited_work_id").alias("_y")).distinct()
    out = pairs
    for name, x, y in (("a_cites_b", "a", "b"), ("b_cites_a", "b", "a")):
        hit = e.withColumn("_hit", F.lit(True))
        out = out.join(hit, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").withColumn(name, F.col("_hit").isNotNull()).drop("_x", "_y", "_hit")
    return out


def compare_papers(pairs: DataFrame, papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) of known works with their titles and links either way."""
    p = papers.select("work_id", "title")
    out = link_status(pairs, edges)
    for k in ("a", "b"):
        out = out.join(p.select(F.col("work_id").alias(k), F.col("title").alias(f"{k}_title")), k)
    return out.select("a", "b", "a_title", "b_title", "a_cites_b", "b_cites_a")


def explain_links(pairs: DataFrame, papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(citing, cited, cites, explanation) for pairs (a: citing, b: cited)."""
    c = compare_papers(pairs, papers, edges)
    return c.select(F.col("a").alias("citing"), F.col("b").alias("cited"), F.col("a_cites_b").alias("cites"), link_explanation(F.col("a_cites_b"), F.col("a_title"), F.col("b_title")).alias("explanation"))
