"""The served functions: reads return DataFrames, writes change the session's tables.

A ``Library`` holds one DataFrame for each table of ``schemas.TABLES`` and acts
for one user. Writes never mutate: they replace a table by a new DataFrame, to
be written as a new version by the caller. Like their readers expect, errors
come back as ``{"error": ...}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.fixed import NO_COLLECTION, NOT_OWNER
from citeloom.operators import folds, graph
from citeloom.operators import search as searching
from citeloom.plans.medallion import gold_topic_rollups
from citeloom.schemas import GOAL_STATES, PROGRESS_STATES, TABLES

DETAIL = "work_id title foundational_score sequence_rank added_at".split()


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


class Library:
    def __init__(self, spark: SparkSession, acting_user: str, tables: dict[str, DataFrame] | None = None, embedder: Callable | None = None, clock=None):
        self.spark, self.user, self.embedder = spark, acting_user, embedder
        self.t = empty_tables(spark) | (tables or {})
        self.now = clock if clock is not None else F.current_timestamp()

    # Reads -------------------------------------------------------------

    def search_papers(self, query: str | list[float], top_k: int = 10, topic_field: str | None = None, year_from: int | None = None, open_access_only: bool = False, seed_topic: str | None = None):
        if isinstance(query, str):
            if not query.strip():
                return {"error": "the query is empty"}
            if self.embedder is None:
                return {"error": "no embedder is loaded"}
            query = [float(x) for x in self.embedder([query.strip()])[0]]
        return searching.search(self.t["paper_embeddings"], self.t["papers"], query, searching.clamp_top_k(top_k), field=topic_field, year_from=year_from, open_access_only=open_access_only, seed_topic=seed_topic)

    def topics(self) -> DataFrame:
        return gold_topic_rollups(self.t["papers"]).orderBy(F.desc("paper_count"), "seed_topic")

    def get_paper(self, work_id: str):
        paper = self.t["papers"].where(F.col("work_id") == work_id)
        if paper.isEmpty():
            return {"error": "no such paper"}
        return {"paper": paper, "prerequisites": self.find_prerequisites(work_id), "unlocks": self.find_unlocks(work_id)}

    def find_prerequisites(self, work_id: str) -> DataFrame:
        e = self.t["citation_edges"].where(F.col("citing_work_id") == work_id)
        return graph.prerequisites(e, self.t["papers"]).drop("of_work_id").orderBy(F.desc_nulls_last("foundational_score"), "work_id")

    def find_unlocks(self, work_id: str) -> DataFrame:
        e = self.t["citation_edges"].where(F.col("cited_work_id") == work_id)
        return graph.unlocks(e, self.t["papers"]).drop("of_work_id").orderBy(F.desc_nulls_last("foundational_score"), "work_id")

    def _pair(self, a: str, b: str) -> DataFrame:
        return self.spark.createDataFrame([(a, b)], "a string, b string")

    def compare_papers(self, work_id_a: str, work_id_b: str):
        out = graph.compare_papers(self._pair(work_id_a, work_id_b), self.t["papers"], self.t["citation_edges"])
        return {"error": "one or both works are unknown"} if out.isEmpty() else out

    def explain_citation_link(self, citing_work_id: str, cited_work_id: str):
        out = graph.explain_links(self._pair(citing_work_id, cited_work_id), self.t["papers"], self.t["citation_edges"])
        return {"error": "one or both works are unknown"} if out.isEmpty() else out

    def get_reading_path(self, collection_id: int) -> DataFrame:
        members = self.t["collection_papers"].where(F.col("collection_id") == collection_id).select("collection_id", "work_id")
        papers = self.t["papers"].select("work_id", "title", "foundational_score")
        path = graph.reading_paths(members.join(papers, "work_id"), self.t["citation_edges"])
        return path.join(papers, "work_id").orderBy("rank")

    def get_collection(self, collection_id: int, check_owner: bool = False):
        if check_owner and (denied := self._denied(collection_id)):
            return denied
        own = self.t["collections"].where(F.col("collection_id") == collection_id)
        if own.isEmpty():
            return {"error": NO_COLLECTION.format(collection_id)}
        members = self.t["collection_papers"].where(F.col("collection_id") == collection_id)
        papers = members.join(self.t["papers"].select("work_id", "title", "foundational_score"), "work_id").select(*DETAIL)
        return {"collection": own, "papers": papers.orderBy(F.asc_nulls_last("sequence_rank"), "added_at", "work_id")}

    def collections(self) -> DataFrame:
        mine = self.t["collections"].where(F.col("user_id") == self.user)
        counts = self.t["collection_papers"].groupBy("collection_id").agg(F.count("work_id").alias("paper_count"))
        return mine.join(counts, "collection_id", "left").withColumn("paper_count", F.coalesce("paper_count", F.lit(0))).orderBy(F.desc("created_at"), "collection_id")

    def goals(self) -> DataFrame:
        return self.t["learning_goals"].where(F.col("user_id") == self.user).orderBy(F.desc("created_at"), "goal_id")

    def notes(self, work_id: str | None = None) -> DataFrame:
        mine = self.t["notes"].where(F.col("user_id") == self.user)
        mine = mine if work_id is None else mine.where(F.col("work_id") == work_id)
        return mine.orderBy(F.desc("created_at"), "note_id")

    def get_progress(self, collection_id: int | None = None) -> DataFrame:
        rows = self.t["reading_progress"].where(F.col("user_id") == self.user).join(self.t["papers"].select("work_id", "title"), "work_id")
        if collection_id is not None:
            rows = rows.join(self.t["collection_papers"].where(F.col("collection_id") == collection_id).select("work_id"), "work_id", "left_semi")
        return rows.select("work_id", "title", "status", "started_at", "completed_at")

    # Writes ------------------------------------------------------------

    def _denied(self, collection_id: int) -> dict | None:
        owner = self.t["collections"].where(F.col("collection_id") == collection_id).select("user_id").head(1)
        if not owner:
            return {"error": NO_COLLECTION.format(collection_id)}
        return None if owner[0].user_id == self.user else {"error": NOT_OWNER}

    def _row(self, table: str, **values) -> DataFrame:
        schema = self.t[table].schema
        one = self.spark.range(1)
        return one.select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def _next(self, table: str, key: str) -> int:
        return (self.t[table].agg(F.max(key)).first()[0] or 0) + 1

    def _ensure_user(self) -> None:
        self.t["users"] = folds.add_missing(self.t["users"], self._row("users", user_id=self.user, created_at=self.now), ["user_id"])

    def _known_paper(self, work_id: str) -> bool:
        return not self.t["papers"].where(F.col("work_id") == work_id).isEmpty()

    def create_learning_goal(self, title: str, description: str | None = None) -> dict:
        if not (title or "").strip():
            return {"error": "the title is blank"}
        self._ensure_user()
        goal_id = self._next("learning_goals", "goal_id")
        self.t["learning_goals"] = self.t["learning_goals"].unionByName(self._row("learning_goals", goal_id=goal_id, user_id=self.user, title=title, description=description, status="active", created_at=self.now, updated_at=self.now))
        return {"goal_id": goal_id}

    def create_collection(self, name: str, goal_id: int | None = None, description: str | None = None) -> dict:
        if not (name or "").strip():
            return {"error": "the name is blank"}
        if goal_id is not None and self.t["learning_goals"].where(F.col("goal_id") == goal_id).isEmpty():
            return {"error": f"goal {goal_id} does not exist"}
        self._ensure_user()
        collection_id = self._next("collections", "collection_id")
        self.t["collections"] = self.t["collections"].unionByName(self._row("collections", collection_id=collection_id, user_id=self.user, goal_id=goal_id, name=name, description=description, created_at=self.now))
        return {"collection_id": collection_id}

    def add_to_collection(self, collection_id: int, work_id: str) -> dict:
        if denied := self._denied(collection_id):
            return denied
        if not self._known_paper(work_id):
            return {"error": f"work {work_id} does not exist"}
        row = self._row("collection_papers", collection_id=collection_id, work_id=work_id, added_at=self.now)
        self.t["collection_papers"] = folds.add_missing(self.t["collection_papers"], row, ["collection_id", "work_id"])
        return {"ok": True}

    def remove_from_collection(self, collection_id: int, work_id: str) -> dict:
        if denied := self._denied(collection_id):
            return denied
        self.t["collection_papers"] = self.t["collection_papers"].where(~((F.col("collection_id") == collection_id) & (F.col("work_id") == work_id)))
        return {"ok": True}

    def record_reading_progress(self, work_id: str, status: str) -> dict:
        if status not in PROGRESS_STATES:
            return {"error": f"status must be one of {', '.join(PROGRESS_STATES)}"}
        if not self._known_paper(work_id):
            return {"error": f"work {work_id} does not exist"}
        self._ensure_user()
        old = self.t["reading_progress"]
        mine = (F.col("user_id") == self.user) & (F.col("work_id") == work_id)
        new = self._row("reading_progress", user_id=self.user, work_id=work_id, status=status, started_at=self.now if status == "in_progress" else None, completed_at=self.now if status == "completed" else None, updated_at=self.now)
        began = old.where(mine).select("user_id", F.col("started_at").alias("_began"))
        new = new.join(began, "user_id", "left").withColumn("started_at", F.coalesce("_began", "started_at"))
        self.t["reading_progress"] = old.where(~mine).unionByName(new.select(*old.columns))
        return {"ok": True}

    def save_note(self, work_id: str, note_text: str, collection_id: int | None = None) -> dict:
        if not (note_text or "").strip():
            return {"error": "the note is blank"}
        if not self._known_paper(work_id):
            return {"error": f"work {work_id} does not exist"}
        self._ensure_user()
        note_id = self._next("notes", "note_id")
        self.t["notes"] = self.t["notes"].unionByName(self._row("notes", note_id=note_id, user_id=self.user, work_id=work_id, collection_id=collection_id, note_text=note_text, created_at=self.now, updated_at=self.now))
        return {"note_id": note_id}

    def save_reading_plan(self, collection_id: int):
        if denied := self._denied(collection_id):
            return denied
        path = self.get_reading_path(collection_id)
        self.t["collection_papers"] = folds.save_plan(self.t["collection_papers"], path)
        return {"path": path}

    def _changed(self, table: str, key: str, value: int, **new) -> dict:
        """Sets columns of one own row, and the time of its last change."""
        rows = self.t[table]
        mine = (F.col(key) == value) & (F.col("user_id") == self.user)
        if rows.where(mine).isEmpty():
            return {"error": f"{key} {value} does not exist"}
        types = dict(rows.dtypes)
        self.t[table] = rows.withColumns({c: F.when(mine, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in (new | {"updated_at": self.now}).items()})
        return {"ok": True}

    def update_goal(self, goal_id: int, status: str | None = None, title: str | None = None, description: str | None = None) -> dict:
        if status is not None and status not in GOAL_STATES:
            return {"error": f"status must be one of {', '.join(GOAL_STATES)}"}
        if title is not None and not title.strip():
            return {"error": "the title is blank"}
        given = {"status": status, "title": title, "description": description}
        return self._changed("learning_goals", "goal_id", goal_id, **{k: v for k, v in given.items() if v is not None})

    def update_note(self, note_id: int, note_text: str) -> dict:
        if not (note_text or "").strip():
            return {"error": "the note is blank"}
        return self._changed("notes", "note_id", note_id, note_text=note_text)

    def delete_goal(self, goal_id: int) -> None:
        self.t["learning_goals"] = self.t["learning_goals"].where(F.col("goal_id") != goal_id)
        self.t["collections"] = folds.set_null(self.t["collections"], self.t["learning_goals"], "goal_id")

    def delete_collection(self, collection_id: int) -> dict:
        if denied := self._denied(collection_id):
            return denied
        self.t["collections"] = self.t["collections"].where(F.col("collection_id") != collection_id)
        self.t["collection_papers"] = folds.cascade(self.t["collection_papers"], self.t["collections"], "collection_id")
        self.t["notes"] = folds.set_null(self.t["notes"], self.t["collections"], "collection_id")
        return {"ok": True}
