"""Ingestion with an inferred schema that is kept, versioned, beside the checkpoint."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.sources.records import CORRUPT, RESCUED, parse_records
from citeloom.streaming.ingest import stream_by_batch

#: ``add``: fields that turn up become columns. ``rescue``: the first schema stays, others go to ``_rescued_data`` until promoted.
MODES = ("add", "rescue")


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: structs field by field, arrays by element, whole numbers and fractions as double, all else as text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b}
        known = [T.StructField(f.name, merged_type(f.dataType, other.pop(f.name, T.NullType()))) for f in a]
        return T.StructType([*known, *[T.StructField(n, t) for n, t in sorted(other.items())]])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def _leaves(kind: T.DataType, change: Callable[[T.DataType], T.DataType]) -> T.DataType:
    """``kind`` with every type that is neither struct nor array changed."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _leaves(f.dataType, change)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_leaves(kind.elementType, change))
    return change(kind)


def _stored(kind: T.DataType) -> T.DataType:
    """What the inference finds, as it is kept: fractions are doubles, and what is no number, truth value or null is text."""
    if isinstance(kind, T.DecimalType):
        return T.LongType() if kind.scale == 0 and kind.precision < 19 else T.DoubleType()
    return kind if isinstance(kind, (T.LongType, T.DoubleType, T.BooleanType, T.NullType)) else T.StringType()


def _readable(schema: T.StructType) -> T.StructType:
    """Fields that have only been null so far are read as text."""
    return _leaves(schema, lambda k: T.StringType() if isinstance(k, T.NullType) else k)


def inferred(lines: DataFrame) -> T.StructType:
    """The fields of all JSON objects in a column ``value``, by one aggregation; lines that are no objects have none."""
    value = F.try_parse_json("value")
    found = lines.where(F.schema_of_variant(value).startswith("OBJECT")).agg(F.schema_of_variant_agg(value).alias("s")).first().s
    if not found or not found.startswith("OBJECT<"):
        return T.StructType()
    kind = lines.sparkSession.sql(f"SELECT CAST(NULL AS {found.replace('OBJECT<', 'STRUCT<')}) AS s").schema["s"].dataType
    return _leaves(kind, _stored)


class SchemaLocation:
    """Versions of a schema in a folder that outlives the stream: ``1.json``, ``2.json`` and so on; hints override what is inferred."""

    def __init__(self, path: str, hints: str = "") -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.hints = T.StructType.fromDDL(hints) if hints else T.StructType()

    def versions(self) -> dict[int, T.StructType]:
        out = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True)):
            if info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with self.fs.open_input_stream(info.path) as file:
                    out[int(info.base_name.removesuffix(".json"))] = T.StructType.fromJson(json.loads(file.read()))
        return dict(sorted(out.items()))

    def latest(self) -> tuple[int, T.StructType]:
        return max(self.versions().items(), default=(0, T.StructType()), key=lambda v: v[0])

    def _hinted(self, schema: T.StructType) -> T.StructType:
        hints = {f.name: f for f in self.hints}
        kept = [hints.pop(f.name, f) for f in schema]
        return T.StructType([*kept, *hints.values()])

    def merge(self, found: T.StructType) -> tuple[int, T.StructType]:
        """The number and fields of the version that holds ``found`` too: the latest if it does, else a new one."""
        number, now = self.latest()
        new = self._hinted(merged_type(now, found))
        if number and new == now:
            return number, now
        self.fs.create_dir(self.root)
        draft = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(json.dumps(new.jsonValue()).encode())
        self.fs.move(draft, f"{self.root}/{number + 1}.json")
        return number + 1, new

    def promote(self, field: str, kind: str) -> int:
        """Makes a rescued top-level field a column of type ``kind``; rows that are there already give what they rescued."""
        return self.merge(T.StructType([T.StructField(field, T.StructType.fromDDL(f"x {kind}")["x"].dataType)]))[0]


def _column(name: str) -> Column:
    return F.col("`{}`".format(name.replace("`", "``")))


def ingest_evolving(spark: SparkSession, source: str, table: str, checkpoint: str, location: SchemaLocation, mode: str = "add") -> None:
    """Appends new files of JSON lines under ``table`` with the schema of ``location`` as it is by then, and returns when all are in.

    Each micro-batch is written under its schema's version and its own number,
    so a batch that is repeated replaces itself. In mode ``rescue`` only the
    first batch is inferred.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def append(batch: DataFrame, number: int) -> None:
        lines = batch.persist()
        try:
            version, schema = location.latest()
            if mode == "add" or not version:
                version, schema = location.merge(inferred(lines))
            parse_records(lines, _readable(schema)).write.mode("overwrite").parquet(f"{table}/version={version}/batch={number}")
        finally:
            lines.unpersist()

    lines = spark.readStream.schema("value string").text(source).withColumn("_source_file", F.col("_metadata.file_path"))
    stream_by_batch(lines, checkpoint, append)


def _conformed(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        old = {f.name: f.dataType for f in have}
        parts = [(_conformed(value[f.name], old[f.name], f.dataType) if f.name in old else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _conformed(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType)):
        return F.to_json(value)
    if isinstance(have, T.StringType) and isinstance(want, (T.StructType, T.ArrayType)):
        return F.from_json(value, want)  # only nulls were there so far
    return value.cast(want)


def read_evolved(spark: SparkSession, table: str, location: SchemaLocation) -> DataFrame:
    """All rows of ``table`` as the latest version has them, with ``_rescued_data``, ``_corrupt_record`` and ``_source_file``."""
    last, latest = location.latest()
    want = _readable(latest)
    more = T.StructType([T.StructField(c, T.StringType()) for c in (CORRUPT, RESCUED, "_source_file")])
    out = None
    for version, schema in location.versions().items():
        have = _readable(schema)
        if not _exists(location, f"{table}/version={version}"):
            continue
        rows = spark.read.schema(T.StructType([*have.fields, *more.fields])).option("recursiveFileLookup", "true").parquet(f"{table}/version={version}")
        old = {f.name: f.dataType for f in have}
        missing = [f for f in want if f.name not in old]
        rescued = F.from_json(RESCUED, "map<string,string>")
        columns = [_conformed(_column(f.name), old[f.name], f.dataType).alias(f.name) if f.name in old else _from_rescued(rescued, f).alias(f.name) for f in want]
        kept = F.col(RESCUED)
        if missing:
            left = F.map_filter(rescued, lambda k, _: ~k.isin([f.name for f in missing]))
            kept = F.when(F.size(left) > 0, F.to_json(left))
        rows = rows.select(*columns, CORRUPT, kept.alias(RESCUED), "_source_file")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], T.StructType([*want.fields, *more.fields])) if out is None else out


def _from_rescued(rescued: Column, field: T.StructField) -> Column:
    text = F.try_element_at(rescued, F.lit(field.name))
    if isinstance(field.dataType, T.StringType):
        return text
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), T.StructType([T.StructField("v", field.dataType)]))["v"]


def _exists(location: SchemaLocation, path: str) -> bool:
    filesystem, plain = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return filesystem.get_file_info(plain).type != pafs.FileType.NotFound
