"""Gold tables that follow changes of the works: only the buckets that a change touches are read and written again."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.plans.medallion import foundational_score, silver_citation_edges
from citeloom.ranks import broadcast_if_small
from citeloom.scratch import materialize

BUCKETS = 64
_WORK = "work_id string, cited_by_count long, fwci double, publication_year int, referenced_works array<string>, in_corpus_in_degree long"
#: Each table, the column whose hash is its bucket, and its columns. ``cited_by`` has the edges once more, by the cited work.
TABLES = {
    "works": ("work_id", _WORK),
    "cites": ("citing_work_id", "citing_work_id string, cited_work_id string"),
    "cited_by": ("cited_work_id", "citing_work_id string, cited_work_id string"),
}


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(work_id, change): works that were added, removed or changed from one version to another, told by a hash of what gold tables read."""
    said = F.xxhash64("cited_by_count", "fwci", "publication_year", F.array_sort("referenced_works"))
    a, b = old.select("work_id", said.alias("_old")), new.select("work_id", said.alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, "work_id", "full_outer").select("work_id", change.alias("change")).where("change IS NOT NULL")


class GoldStore:
    """Gold tables in buckets. A manifest a version names, for every bucket, the version that wrote it; the last manifest is the table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def version(self) -> int:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return max((int(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json") and i.base_name[0] != "."), default=0)

    def _manifest(self) -> dict[str, dict[str, int]]:
        if not (n := self.version()):
            return {t: {} for t in TABLES}
        with self.fs.open_input_stream(f"{self.root}/manifests/{n}.json") as file:
            return json.loads(file.read())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its ``buckets`` (BUCKETS at most)."""
        wrote = self._manifest()[table]
        paths = [f"{self.path}/{table}/version={v}/bucket={b}" for b, v in wrote.items() if buckets is None or int(b) in buckets]
        columns = TABLES[table][1]
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    def _touched(self, keys: DataFrame, column: str) -> list[int]:
        return [r.b for r in keys.select(bucket_of(column, self.buckets).alias("b")).distinct().collect()]

    def _publish(self, parts: dict[str, tuple[DataFrame, list[int]]]) -> None:
        version, manifest = self.version() + 1, self._manifest()
        for name, (df, touched) in parts.items():
            key = TABLES[name][0]
            df.withColumn("bucket", bucket_of(key, self.buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
            there = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{name}/version={version}"))
            filled = {i.base_name.removeprefix("bucket=") for i in there if i.base_name.startswith("bucket=")}
            for b in map(str, touched):
                manifest[name].pop(b, None)
            manifest[name] |= dict.fromkeys(filled, version)
        self.fs.create_dir(f"{self.root}/manifests")
        draft = f"{self.root}/manifests/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        self.fs.move(draft, f"{self.root}/manifests/{version}.json")

    def apply(self, upserts: DataFrame, removed: DataFrame | None = None) -> None:
        """Follows changes: ``upserts`` are works (work_id, cited_by_count, fwci, publication_year, referenced_works), ``removed`` ids (work_id).

        Of the stored tables only the buckets of the works that change, of
        what they cite or cited, and of what cites works that come are read;
        the in-degrees move by the edges that come and go. A work is removed
        before it is upserted. All tables change at once, when the manifest is
        written; an attempt that fails before leaves the version as it was.
        """
        new = materialize(upserts.select("work_id", F.col("cited_by_count").cast("long"), F.col("fwci").cast("double"), F.col("publication_year").cast("int"), "referenced_works").where("work_id IS NOT NULL").dropDuplicates(["work_id"]), "gold-upserts")
        gone = new.select("work_id").limit(0) if removed is None else removed.select("work_id").where("work_id IS NOT NULL").distinct().join(new, "work_id", "left_anti")
        gone = materialize(gone, "gold-removed")
        changing = materialize(new.select("work_id").union(gone), "gold-changing")

        old = self.read("works", self._touched(changing, "work_id")).join(broadcast_if_small(changing), "work_id", "left_semi")
        old = materialize(old, "gold-old")
        was, now = silver_citation_edges(old).distinct(), silver_citation_edges(new).where("cited_work_id IS NOT NULL").distinct()
        was = materialize(was.where("cited_work_id IS NOT NULL"), "edges-were")
        went, came = was.join(now, ["citing_work_id", "cited_work_id"], "left_anti"), now.join(was, ["citing_work_id", "cited_work_id"], "left_anti")
        went, came = materialize(went, "edges-went"), materialize(came, "edges-came")

        parts: dict[str, tuple[DataFrame, list[int]]] = {}
        for name in ("cites", "cited_by"):
            key = TABLES[name][0]
            touched = self._touched(went.union(came), key)
            kept = self.read(name, touched).join(broadcast_if_small(went), ["citing_work_id", "cited_work_id"], "left_anti")
            parts[name] = kept.unionByName(came), touched

        # In-degrees: of works that come by all who cite them, of others by the edges that came and went.
        arrived = materialize(new.select("work_id").join(old.select("work_id"), "work_id", "left_anti"), "gold-arrived")
        moved = came.select("citing_work_id", "cited_work_id", F.lit(1).alias("d")).union(went.select("citing_work_id", "cited_work_id", F.lit(-1)))
        # All citing works are in the corpus: an edge is stored with its citing work, and goes with it.
        deltas = moved.groupBy(F.col("cited_work_id").alias("work_id")).agg(F.sum("d").alias("delta"))
        citing_arrived = self.read("cited_by", self._touched(arrived, "work_id")).join(went, ["citing_work_id", "cited_work_id"], "left_anti").unionByName(came).distinct()
        full = citing_arrived.join(broadcast_if_small(arrived.select(F.col("work_id").alias("cited_work_id"))), "cited_work_id", "left_semi").groupBy(F.col("cited_work_id").alias("work_id")).agg(F.count("*").alias("full"))
        deltas, full = materialize(deltas, "degree-deltas"), materialize(full, "degrees-of-new")

        touched = self._touched(changing.union(deltas.select("work_id")), "work_id")
        stay = self.read("works", touched).join(broadcast_if_small(gone), "work_id", "left_anti")
        before = stay.select("work_id", F.col("in_corpus_in_degree").alias("_before"))
        rest = stay.join(broadcast_if_small(new.select("work_id")), "work_id", "left_anti")
        fresh = new.join(before, "work_id", "left").withColumn("in_corpus_in_degree", F.coalesce("_before", F.lit(0))).select(*rest.columns)
        works = rest.unionByName(fresh).join(broadcast_if_small(deltas), "work_id", "left").join(broadcast_if_small(full), "work_id", "left").join(broadcast_if_small(arrived.withColumn("_new", F.lit(True))), "work_id", "left")
        degree = F.when(F.col("_new"), F.coalesce("full", F.lit(0))).otherwise(F.col("in_corpus_in_degree") + F.coalesce("delta", F.lit(0)))
        works = works.withColumn("in_corpus_in_degree", degree.cast("long")).select(*rest.columns)
        parts["works"] = works, touched
        self._publish({name: (materialize(df, f"new-{name}"), buckets) for name, (df, buckets) in parts.items()})

    def graph(self) -> DataFrame:
        """Edges between works of the corpus: stored edges whose cited work is there (their citing work is)."""
        return self.read("cites").join(self.read("works").select(F.col("work_id").alias("cited_work_id")), "cited_work_id", "left_semi").select("citing_work_id", "cited_work_id")

    def metrics(self) -> DataFrame:
        """As ``gold_paper_metrics``."""
        works = self.read("works").select("work_id", "cited_by_count", "fwci", "publication_year", "in_corpus_in_degree")
        return works.withColumn("foundational_score", foundational_score())
