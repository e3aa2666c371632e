"""Vectors: literals, cosine similarity and a deterministic embedder."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.shipping import ship_package

BATCH = 32


@F.arrow_udf(T.StringType())
def _literal(v: pa.Array) -> pa.Array:
    rows = ([x for x in row if x is not None] if row is not None else None for row in v.to_pylist())
    return pa.array([None if row is None else "[" + ",".join(["%.8f"] * len(row)) % tuple(row) + "]" for row in rows], pa.string())


def vector_literal(v: Column) -> Column:
    """``[x,y]`` with eight decimals, nulls left out; null for no vector.

    The number itself is rounded, an exact half to the even digit, as in C and
    Python: the engine's formatter rounds the shortest decimal form half up.
    """
    ship_package(SparkSession.active())
    return _literal(v.cast("array<double>"))


def rounded(x: Column, places: int) -> Column:
    """``x`` times a power of ten to the nearest whole number, halves away from 0, and back; too large a number stays."""
    scale = F.lit(10.0**places)
    up = F.round(x * scale)
    return F.when(F.abs(up) < F.lit(float("inf")), up / scale).otherwise(x)


def from_literal(s: Column) -> Column:
    inside = F.substring(s, F.lit(2), F.length(s) - 2)
    return F.when(inside == "", F.array().cast("array<double>")).otherwise(F.split(inside, ",").cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance, in double precision; null if a length is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def hashing_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words: a stand-in where no model can be loaded.

    Words are divided by ASCII white space, A-Z is lower-cased; the first 32
    bits of a word's MD5 say its place and, by the highest, its sign.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(text.encode("utf-8", "replace").lower().split()).items():
                h = int.from_bytes(md5(word, usedforsecurity=False).digest()[:4], "big")
                row[h % size] += n if h >> 31 else -n
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return embed


def embed(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "embedding") -> DataFrame:
    """Adds the embedding of ``text``. ``make`` is called once for each task that has rows, so a model is loaded lazily."""
    ship_package(df.sparkSession)
    schema = df.withColumn(column, F.array().cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            if len(rows):
                model = model or make()
                values: Iterable = (v for i in range(0, len(rows), BATCH) for v in model(rows[text].iloc[i : i + BATCH].fillna("").tolist()))
                yield rows.assign(**{column: list(values)})

    return df.mapInPandas(run, schema)
