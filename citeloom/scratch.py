"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths handed out and not removed yet, by application.
_PATHS: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one; only a local master without it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="spark-citeloom-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], True)
    return f"file://{_OWN[sc.applicationId]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables; DataFrames that still read them can no longer be evaluated."""
    handed_out = _PATHS.get(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in handed_out:
            handed_out.remove(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables that are written inside."""
    before = set(_PATHS.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_scratch(spark, *[p for p in _PATHS.get(spark.sparkContext.applicationId, []) if p not in before])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of the files.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and values that depend on task order are fixed from then on. The files
    stay until ``drop_scratch`` or the end of a ``scratch_scope``, as the scan
    is lazy.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
