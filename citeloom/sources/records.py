"""Files of JSON records: readers that rescue what the schema lacks, parquet snapshots and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import https_url, slug

CORRUPT = "_corrupt_record"
RESCUED = "_rescued_data"


_PLACED = "array<struct<path:string,value:string>>"


def _beyond(text: Column, kind: T.DataType) -> Column:
    """array<struct<path, value>>: what a JSON text holds beyond its type, at any depth; path like ``.a[0].b``."""
    none = F.array().cast(_PLACED)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        inside = F.transform(F.from_json(text, "array<string>"), lambda e, i: _below(F.concat(F.lit("["), i.cast("string"), F.lit("]")), _beyond(e, kind.elementType)))
        return F.coalesce(F.flatten(inside), none)
    if not isinstance(kind, T.StructType):
        return none

    def of(entries: Column) -> Column:
        known = F.array(*[F.lit(f.name) for f in kind.fields])
        own = F.transform(F.filter(entries, lambda x: ~F.array_contains(known, x["key"])), lambda x: F.struct(F.concat(F.lit("."), x["key"]).alias("path"), x["value"].alias("value")))
        parts = [F.coalesce(own, none)]
        for f in kind.fields:
            if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                value = F.get(F.filter(entries, _is(f.name)), F.lit(0))["value"]
                parts.append(_below(F.lit(f".{f.name}"), _beyond(value, f.dataType)))
        return F.concat(*parts)

    return F.coalesce(F.get(F.transform(F.array(F.map_entries(F.from_json(text, "map<string,string>"))), of), F.lit(0)), none)


def _is(name: str):
    return lambda x: x["key"] == F.lit(name)


def _below(place: Column, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.concat(place, x["path"]).alias("path"), x["value"].alias("value")))


def parse_records(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Records from a column ``value`` of JSON lines, batch or stream.

    Fields that the schema does not name, at any depth, go to
    ``_rescued_data`` (JSON: place in the record, like ``authorships[0].x``,
    to value), a value of the wrong type leaves its field null and the line in
    ``_corrupt_record``. Blank lines are no records.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    with_corrupt = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.where(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", with_corrupt, options)
    beyond = _beyond(F.col("value"), T.StructType(fields))
    unknown = F.map_from_entries(F.transform(F.array_distinct(beyond), lambda x: F.struct(F.substring(x["path"], 2, 1 << 30).alias("key"), x["value"].alias("value"))))
    more = [c for c in rows.columns if c != "value"]
    out = rows.select(*more, parsed.alias("r"), F.when(F.size(beyond) > 0, F.to_json(unknown)).alias(RESCUED))
    return out.select("r.*", RESCUED, *more)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_records(spark.read.text(path).withColumn("_source_file", F.col("_metadata.file_path")), schema)


def stream_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.readStream.schema("value string").text(path)
    return parse_records(lines.withColumn("_source_file", F.col("_metadata.file_path")), schema)


def well_formed(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNotNull()).select(CORRUPT, "_source_file")


def manifest_files(spark: SparkSession, manifest: str) -> list[str]:
    """The file addresses of a snapshot's manifest ({"entries": [{"url": ...}]})."""
    entries = spark.read.text(manifest, wholetext=True).select(F.from_json("value", "entries array<struct<url:string>>").alias("m"))
    urls = entries.select(F.explode("m.entries.url").alias("u")).select(https_url(F.col("u")).alias("u"))
    return [r.u for r in urls.collect()]  # one entry a file


def read_snapshot(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """A parquet snapshot; only ``columns`` reach the scan."""
    return spark.read.parquet(*paths).select(*columns)


def write_jsonl(df: DataFrame, path: str, by: str | None = "_seed_topic") -> None:
    """JSON lines, with one folder for each slug of ``by``."""
    if by is None:
        df.write.mode("overwrite").json(path)
    else:
        df.withColumn("slug", slug(F.col(by))).write.mode("overwrite").partitionBy("slug").json(path)

