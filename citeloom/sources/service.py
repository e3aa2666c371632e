"""A record service as a Python data source: look-ups by id, listings by topic, and who cites whom.

    spark.dataSource.register(works_service(connect, schema))
    spark.read.format("citeloom_works").option("topics", '["a"]').load()
    spark.read.format("citeloom_works").load().where("id IN ('W1', 'W2')")   # with filters=True
    spark.readStream.format("citeloom_works").option("topics", '["a"]').load()

What is asked for is divided into calls, a partition each; a call that fails is
tried again within its task.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Any, Protocol, TypeVar

import pandas as pd
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from citeloom.fixed import CALL_IDS, CALL_ROWS, RETRIES, RETRY_SECONDS, SEND_ROWS
from citeloom.shipping import ship_package

A = TypeVar("A")
#: How a record is reached: by its id, by the topic it is listed under, or by a work that it cites.
WAYS = ("id", "cites", "topic")
#: Row groups that a connection to files keeps.
HELD_GROUPS = 4


class Service(Protocol):
    """What a connection offers. Records are dictionaries; listings have a fixed order."""

    def by_ids(self, ids: list[str]) -> list[dict]: ...

    def count(self, topic: str) -> int: ...

    def listing(self, topic: str, start: int, stop: int) -> list[dict]: ...

    def citing(self, ids: list[str], start: int, stop: int) -> list[tuple[str, dict]]:
        """(cited id, record) of the works that cite any of ``ids``; fewer than asked for at the end."""


def persistently(call: Callable[[], A], tries: int = RETRIES, wait: float = RETRY_SECONDS) -> A:
    """The result of ``call``; after a failure it waits ``wait`` seconds longer each time, and the last failure counts."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait * attempt)
    raise ValueError("at least one try is needed")


@dataclass
class Call(InputPartition):
    """One call: ``ids`` to look up or whose citing works are wanted, or a stretch of a topic's listing."""

    way: str
    ids: list[str]
    topic: str | None = None
    start: int = 0
    stop: int = 0


def id_calls(way: str, ids: Sequence[str]) -> list[Call]:
    once = list(dict.fromkeys(ids))
    return [Call(way, once[i : i + CALL_IDS]) for i in range(0, len(once), CALL_IDS)]


def listing_calls(topic: str, start: int, stop: int) -> list[Call]:
    return [Call("topic", [], topic, i, min(i + CALL_ROWS, stop)) for i in range(start, stop, CALL_ROWS)]


def records_of(service: Service, call: Call, tries: int, wait: float) -> Iterator[tuple[str, dict]]:
    """(value of the way, record) of one call; citing works come in as many pages as there are."""
    if call.way == "id":
        yield from (((r["id"]), r) for r in persistently(lambda: service.by_ids(call.ids), tries, wait))
    elif call.way == "topic":
        yield from ((call.topic, r) for r in persistently(lambda: service.listing(call.topic, call.start, call.stop), tries, wait))
    else:
        at = 0
        while True:
            page = persistently(lambda at=at: service.citing(call.ids, at, at + CALL_ROWS), tries, wait)
            yield from page
            if len(page) < CALL_ROWS:
                return
            at += CALL_ROWS


def works_service(connect: Callable[[], Service], schema: str, name: str = "citeloom_works", filters: bool = False, tries: int = RETRIES, wait: float = RETRY_SECONDS) -> type[DataSource]:
    """A data source over ``connect()``, which is called once for each task.

    Rows have the columns of ``schema`` (``id`` among them), ``topic`` and
    ``cites``: the topic whose listing was asked for and the cited work that
    was, else null. Options ``ids``, ``cites`` and ``topics`` (JSON lists) say
    what is asked for, and with ``filters`` so do pushed-down filters on the
    columns (the session must have them enabled, else Spark refuses the
    source); ids decide the calls before cited works and topics, and Spark
    evaluates all filters on the rows. ``per_topic`` stops each listing early. Unknown ids are absent, ids asked for twice are
    looked up once. A stream delivers each listing from where it stopped.
    """
    fields = StructType.fromDDL(schema).fieldNames()

    def rows(call: Call) -> Iterator[tuple]:
        for value, record in records_of(connect(), call, tries, wait):
            yield (*(record.get(f) for f in fields), value if call.way == "topic" else None, value if call.way == "cites" else None)

    class Reader(DataSourceReader):
        def __init__(self, asked: dict[str, list[str]], per_topic: int | None) -> None:
            self.asked, self.per_topic = asked, per_topic

        def partitions(self) -> list[Call]:
            for way in ("id", "cites"):
                if way in self.asked:
                    return id_calls(way, self.asked[way])
            if "topic" not in self.asked:
                raise ValueError("the service cannot list everything: ask for ids, cites or topics")
            out: list[Call] = []
            for topic in dict.fromkeys(self.asked["topic"]):
                n = persistently(lambda t=topic: connect().count(t), tries, wait)
                out += listing_calls(topic, 0, n if self.per_topic is None else min(n, self.per_topic))
            return out

        def read(self, partition: Call) -> Iterator[tuple]:
            return rows(partition)

    class FilteringReader(Reader):
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if isinstance(f, (EqualTo, In)) and f.attribute[0] in WAYS and len(f.attribute) == 1:
                    values = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
                    known = self.asked.get(f.attribute[0])
                    self.asked[f.attribute[0]] = values if known is None else [v for v in known if v in set(values)]
                yield f  # Spark looks at the rows again

    class StreamReader(DataSourceStreamReader):
        def __init__(self, topics: list[str]) -> None:
            self.topics = topics

        def initialOffset(self) -> dict[str, int]:
            return {t: 0 for t in self.topics}

        def latestOffset(self) -> dict[str, int]:
            return {t: persistently(lambda t=t: connect().count(t), tries, wait) for t in self.topics}

        def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Call]:
            return [c for t, n in end.items() for c in listing_calls(t, start.get(t, 0), n)]

        def read(self, partition: Call) -> Iterator[tuple]:
            return rows(partition)

    class Works(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{schema}, topic string, cites string"

        def _asked(self) -> dict[str, list[str]]:
            options = {"id": "ids", "cites": "cites", "topic": "topics"}
            return {way: json.loads(self.options[o]) for way, o in options.items() if o in self.options}

        def reader(self, schema: StructType) -> DataSourceReader:
            return (FilteringReader if filters else Reader)(self._asked(), int(self.options["per_topic"]) if "per_topic" in self.options else None)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            asked = self._asked()
            if "topic" not in asked:
                raise ValueError("a stream follows listings: give option 'topics'")
            return StreamReader(asked["topic"])

    return Works


def look_up(ids: DataFrame, connect: Callable[[], Service], schema: str, way: str = "id", tries: int = RETRIES, wait: float = RETRY_SECONDS) -> DataFrame:
    """The records of a table of ``ids`` (id), or with ``way`` "cites" the records that cite them, each with ``cites``.

    For more ids than a filter holds: the distinct ids are dealt to the tasks
    by ranges, which call for CALL_IDS neighbours at a time, so that a service
    that has its records in order looks in few places for a call. Null ids are
    not asked for.
    """
    ship_package(ids.sparkSession)
    fields = StructType.fromDDL(schema)
    out = StructType([*fields.fields, StructField("cites", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = None
        for asked in batches:
            for call in id_calls(way, asked["id"].tolist()):
                service = service or connect()
                found = records_of(service, call, tries, wait)
                while some := [(*(r.get(f) for f in fields.fieldNames()), v if way == "cites" else None) for v, r in islice(found, SEND_ROWS)]:
                    yield pd.DataFrame(some, columns=out.fieldNames(), dtype=object)

    once = ids.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    return once.repartitionByRange("id").sortWithinPartitions("id").mapInPandas(run, out)


class FileService:
    """A service over parquet folders: ``works`` (id, topic, cited_by_count, ...) and ``edges`` (citing, cited).

    Listings go by citations, most first, then by id. Ids are looked up in the
    row groups whose bounds hold any of them, of which the last HELD_GROUPS
    stay, so works in the order of their ids are read once by calls in that
    order; in another order each call reads all.
    """

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")
        self._bounds: list[tuple] | None = None
        self._held: dict[tuple, tuple] = {}

    def _row_groups(self) -> list[tuple]:
        """(fragment, number, least id, greatest id) of each row group of the works; the bounds are None where the file has none."""
        if self._bounds is None:
            self._bounds = []
            for fragment in dataset.dataset(f"{self.path}/works", format="parquet").get_fragments():
                fragment.ensure_complete_metadata()
                for group in fragment.row_groups:
                    known = (group.statistics or {}).get("id", {})
                    self._bounds.append((fragment, group.id, known.get("min"), known.get("max")))
        return self._bounds

    def _group(self, fragment: dataset.ParquetFileFragment, number: int) -> tuple:
        """(rows, place of each id) of one row group."""
        key = (fragment.path, number)
        if key not in self._held:
            rows = fragment.subset(row_group_ids=[number]).to_table()
            while len(self._held) >= HELD_GROUPS:
                self._held.pop(next(iter(self._held)))
            self._held[key] = (rows, {x: i for i, x in enumerate(rows["id"].to_pylist())})
        return self._held[key]

    def _works(self, condition: pc.Expression) -> list[dict]:
        return dataset.dataset(f"{self.path}/works", format="parquet").to_table(filter=condition).to_pylist()

    def by_ids(self, ids: list[str]) -> list[dict]:
        asked = sorted({i for i in ids if i is not None})
        found: dict[str, dict] = {}
        for fragment, number, least, greatest in self._row_groups():
            at = 0 if least is None else bisect_left(asked, least)
            if at < len(asked) and (greatest is None or asked[at] <= greatest):
                rows, places = self._group(fragment, number)
                if hits := [places[i] for i in asked[at:] if i in places]:
                    found |= {r["id"]: r for r in rows.take(hits).to_pylist()}
        return list(found.values())

    def count(self, topic: str) -> int:
        return dataset.dataset(f"{self.path}/works", format="parquet").count_rows(filter=pc.field("topic") == topic)

    def listing(self, topic: str, start: int, stop: int) -> list[dict]:
        return sorted(self._works(pc.field("topic") == topic), key=lambda r: (-(r["cited_by_count"] or 0), r["id"]))[start:stop]

    def citing(self, ids: list[str], start: int, stop: int) -> list[tuple[str, dict]]:
        edges = dataset.dataset(f"{self.path}/edges", format="parquet").to_table(filter=pc.field("cited").isin(ids))
        pairs = sorted(set(zip(*(edges[c].to_pylist() for c in ("cited", "citing")), strict=True)))
        known: dict[str, Any] = {r["id"]: r for r in self.by_ids([c for _, c in pairs])}
        return [(cited, known[c]) for cited, c in pairs if c in known][start:stop]
