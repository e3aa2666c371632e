"""Scalar functions over ids, texts and JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.fixed import CHUNK_OVERLAP, CHUNK_SIZE, CITES, NO_EDGE, READ_FIRST
from citeloom.ranks import global_rank
from citeloom.shipping import ship_package

_EDGES = r"(?U)^\s+|\s+$"
_SPACES = re.compile(r"[ \t\n\f\r]+")


def short_id(col: Column | str) -> Column:
    """What follows the last slash; a bare id stays as it is."""
    return F.substring_index(col, "/", -1)


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, _EDGES, "")


def rebuild_abstract(index: str | None) -> str | None:
    """The text of an inverted index {word: [positions]}; None if there is none.

    The last of several words at one position wins, negative and fractional
    positions and values that are no lists are skipped, gaps are closed.
    """
    if index is None or not index.strip():
        return None
    try:
        entries = json.loads(index)
    except ValueError:
        return None
    if not isinstance(entries, dict):
        return None
    words = {int(p): word for word, places in entries.items() if isinstance(places, list) for p in places if isinstance(p, int) and p >= 0}
    return " ".join(words[p] for p in sorted(words)).strip() or None


@F.pandas_udf(T.StringType())
def _rebuild(index: pd.Series) -> pd.Series:
    return index.map(rebuild_abstract, na_action="ignore")


def reconstruct_abstract(index: Column | str) -> Column:
    """``rebuild_abstract`` by Arrow batch.

    It stays in Python because JSON functions of the engine cannot follow the
    rules: they void a whole map for one bad position and lose key order. Read
    as VARIANT where that does no harm, with Python for the rest, it took ten
    times as long.
    """
    ship_package(SparkSession.active())
    return _rebuild(index)


def inverted_index(text: str | None) -> str | None:
    """The inverted index {word: [positions]} of a text, as JSON; words are divided by the ASCII white space of SQL's ``\\s``. None for no text."""
    if text is None:
        return None
    places: dict[str, list[int]] = {}
    for position, word in enumerate(w for w in _SPACES.split(text) if w):
        places.setdefault(word, []).append(position)
    return json.dumps(places, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _invert(text: pd.Series) -> pd.Series:
    return text.map(inverted_index, na_action="ignore")


def invert_abstract(text: Column | str) -> Column:
    """``inverted_index`` by Arrow batch: each row by itself, so that texts with one key stay apart."""
    ship_package(SparkSession.active())
    return _invert(text)


def payload_variant(payload: Column | str) -> Column:
    """A JSON payload as VARIANT; null where it is no JSON."""
    return F.try_parse_json(payload)


def payload_fields(payloads: DataFrame, fields: dict[str, tuple[str, str]], column: str = "payload") -> DataFrame:
    """``payloads`` with typed columns ``fields`` (name: path like ``$.a.b``, type) in place of the JSON.

    A path that is missing, or whose value has another type, is null; the JSON
    is parsed once a row.
    """
    parsed = payloads.withColumn(column, payload_variant(column))
    rest = [c for c in payloads.columns if c != column]
    return parsed.select(*rest, *[F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in fields.items()])


def payload_entries(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(key column, field, kind, json) for each top-level field of each payload that is an object; others have no row."""
    parsed = payloads.select(key, payload_variant(column).alias("_v"))
    opened = parsed.lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return opened.where(F.col("key").isNotNull()).select(key, F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"), F.to_json("value").alias("json"))


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: windows of ``size`` characters that overlap, stripped, empty ones dropped.

    The last window is the first that reaches the end. Null or blank: no chunk.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / F.lit(step)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(text.isNull() | (F.length(text) == 0), F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda p: p != ""))


def batched(df: DataFrame, id_column: str, size: int) -> DataFrame:
    """(batch, ids): the ids in order, ``size`` to a batch, the last one shorter.

    Places are counted without a global window: rows are ranged by id and written
    once, counted for each range and moved up by the ranges before.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    placed = global_rank(df.select(F.col(id_column).alias("id")), ["id"], "batches", "place")
    numbered = placed.select(F.floor(F.col("place") / size).alias("batch"), "id")
    return numbered.groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def in_batches(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    rest = list(items)
    while rest:
        yield rest[:size]
        rest = rest[size:]


def or_filter(field: str, ids: Column) -> Column:
    """``field:A|B`` over an array of ids or urls; an empty array is an error."""
    joined = F.array_join(F.transform(ids, short_id), "|")
    return F.when(F.size(ids) > 0, F.concat(F.lit(f"{field}:"), joined)).otherwise(F.raise_error(F.lit("an OR filter needs an id")).cast("string"))


def slug(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit("_"))


def truncated(col: Column, size: int = 18) -> Column:
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size - 1), F.lit("…"))).otherwise(col)


def https_url(col: Column) -> Column:
    """A bucket address ``s3://name/key`` as ``https://name.s3.amazonaws.com/key``."""
    return F.regexp_replace(col, "^s3://([^/]+)/", "https://$1.s3.amazonaws.com/")


def quoted(col: Column) -> Column:
    """A string in single quotes, or in double quotes if only single ones occur in it."""
    bare = F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(col.contains("'") & ~col.contains('"'), F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(bare, F.lit("'"), F.lit("\\'")), F.lit("'")))


def link_explanation(direct: Column, citing_title: Column, cited_title: Column) -> Column:
    said = F.concat(quoted(citing_title), F.lit(CITES), quoted(cited_title), F.lit(READ_FIRST))
    return F.when(direct, said).otherwise(F.lit(NO_EDGE))


def agent_reply(response: Column) -> Column:
    """The reply in an agent's JSON response, in any of three shapes; null if there is none.

    First choice's message, else the last assistant message with text, else
    the first text of the last message in the output list that has one.
    """
    def said(c: Column) -> Column:
        return F.when(F.length(strip(c)) > 0, c)

    choice = said(F.get_json_object(response, "$.choices[0].message.content"))
    messages = F.from_json(F.get_json_object(response, "$.messages"), "array<struct<role:string,content:string>>")
    spoken = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.length(strip(m["content"])) > 0))
    output = F.from_json(F.get_json_object(response, "$.output"), "array<struct<type:string,content:array<struct<text:string>>>>")
    texts = F.transform(F.filter(output, lambda o: o["type"] == "message"), lambda o: F.get(F.filter(o["content"], lambda p: F.length(strip(p["text"])) > 0), F.lit(0))["text"])
    texts = F.filter(texts, lambda t: t.isNotNull())
    return F.coalesce(choice, F.try_element_at(spoken, F.lit(-1))["content"], F.try_element_at(texts, F.lit(-1)))
