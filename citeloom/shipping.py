"""Makes this package importable on executors that do not have it installed, and bounds what they hand to Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: An Arrow batch that goes to Python holds about this many bytes and this many rows at most.
ARROW_BATCH_BYTES, ARROW_BATCH_ROWS = 8 << 20, 2000


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of this package to the session, once for each application.

    Only operators that run Python on executors need it. It equals giving
    ``--py-files`` to ``spark-submit``; Spark's own file server hands it out.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(top)
    target = os.path.join(tempfile.mkdtemp(prefix="citeloom-ship-"), "citeloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in sorted(os.walk(top)):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, top)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, for tables with very long texts; smaller bounds that are set stay."""
    for key, most in (("maxBytesPerBatch", ARROW_BATCH_BYTES), ("maxRecordsPerBatch", ARROW_BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))
