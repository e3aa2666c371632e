"""Sharding by Hilbert-curve order over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import broadcast_if_small, global_rank, materialize, table

BITS = 4
SHARDS = 16


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell with ``bits`` bits on each axis.

    Skilling's transform, as one fold over the (bit, axis) steps. The number of
    axes times ``bits`` may be 62 at most.
    """
    n = len(axes)
    if not axes or bits < 1 or n * bits > 62:
        raise ValueError("axes times bits must be between 1 and 62")
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else None
    cell = F.array(*[a.cast("int") for a in axes])

    def undo(x: Column, s: Column) -> Column:
        mask, own = s["q"] - 1, F.get(x, s["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(mask)
        low = own.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, j: F.when(low, F.when(j == 0, v.bitwiseXOR(mask)).otherwise(v)).otherwise(
                F.when((j == 0) | (j == s["i"]), F.when(s["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)
            ),
        )

    if steps is not None:
        cell = F.aggregate(steps, cell, undo)

    def gray(x: Column, j: Column) -> Column:
        return F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v))

    # The three remaining steps need the previous value more than once: each is
    # a transform of a one-element array, so that Catalyst does not inline it.
    coded = F.transform(F.array(cell), lambda x: F.transform(x, lambda _v, j: gray(x, j)))
    bit_list = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")

    def finish(x: Column) -> Column:
        t = F.aggregate(bit_list, F.lit(0), lambda a, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    done = F.transform(coded, finish)

    def weave(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(F.get(x, s["i"]).bitwiseAND(F.call_function("shiftleft", F.lit(1), s["b"])) != 0, 1).otherwise(0))

    return F.get(F.transform(done, weave), F.lit(0))


def category_levels(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, level): values in order, quantised by the share of rows before them.

    It has a row for each distinct value. Nulls count as the empty string.
    Values are dealt by ranges and summed up inside them; the sums of the
    ranges before, a row for each partition, are added.
    """
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)).agg(F.count("*").alias("_n"))
    ranged = materialize(counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), f"counts-{column}")
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", F.coalesce(F.sum("_all").over(above), F.lit(0)).alias("_start"))
    whole = ranged.agg(F.sum("_n")).first()[0] or 1
    placed = ranged.join(F.broadcast(totals), "_part").withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return placed.select(column, F.floor(F.col("_before") / whole * (1 << bits)).cast("int").alias("_level"))


def size_level(size: Column, bits: int) -> Column:
    """The binary logarithm of the size: level 0 up to 511 bytes, one more for each doubling."""
    return F.greatest(F.least(F.floor(F.log2(size.cast("double"))), F.lit((1 << bits) + 7)) - 8, F.lit(0)).cast("int")


def hilbert_shards(docs: DataFrame, n_shards: int = SHARDS, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Places every row of ``docs`` in one of ``n_shards`` runs of the curve.

    Axes are the language, the source and the binary logarithm of the size.
    The order is (curve index, hash of the text, doc_id); runs are cut so that
    row counts differ by one at most. Equal texts take the cell of the first
    of their (lang, source) pairs, whatever their own metadata, so copies are
    neighbours and in one shard unless a cut falls between them (or there are
    more of them than a shard holds): at most ``n_shards`` - 1 groups are cut.

    Returns doc_id, source, lang, size, text_crc32, hilbert, shard, slot and
    the columns named in ``carry``. A null text has size 1 and CRC 0; a very
    long one counts whole; null metadata are the empty string; a null doc_id
    comes first among copies; repeated rows each get a slot, in any order
    among themselves; an empty table gives no rows. Other columns of ``docs``,
    whatever their names, are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select(
            F.col("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
            *carry,
        ),
        "shard-base",
    )
    own = F.struct("lang", "source")
    copies = base.groupBy("_text", "size").agg(F.min(own).alias("_first"), F.max(own).alias("_last")).where("_first <> _last").select("_text", "size", "_first")
    cell = base.join(broadcast_if_small(materialize(copies, "shard-copies")), ["_text", "size"], "left").withColumn("_own", F.coalesce("_first", own))
    cell = cell.select(*base.columns, F.col("_own.lang").alias("_key_lang"), F.col("_own.source").alias("_key_source"))
    for column in ("source", "lang"):
        levels = materialize(category_levels(base, column, bits), f"levels-{column}").select(F.col(column).alias(f"_key_{column}"), F.col("_level").alias(f"_{column}"))
        cell = cell.join(broadcast_if_small(levels), f"_key_{column}")
    cell = cell.withColumn("hilbert", hilbert_index([F.col("_lang"), F.col("_source"), size_level(F.col("size"), bits)], bits)).select(*base.columns, "hilbert")
    ranked = global_rank(cell, ["hilbert", "_text", "doc_id"], "shard-order").drop("_text")
    total = ranked.count()
    # Integer arithmetic: shard s begins at place ceil(s * total / n_shards).
    ranked = ranked.withColumn("_s", F.expr(f"_rank * {n_shards} div {max(total, 1)}"))
    begin = F.expr(f"(_s * {total} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", F.col("_s").cast("int")).withColumn("slot", (F.col("_rank") - begin).cast("long")).drop("_s", "_rank")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, bits: int = BITS) -> None:
    """Writes ``docs`` with one folder for each shard, rows in slot order, for file pruning by language, source and size.

    Every row is written once, with all its columns and hilbert and slot: rows
    are told apart by a number of their own, so null and repeated ids do no
    harm. Columns named hilbert, shard or slot are replaced.
    """
    kept = docs.drop("hilbert", "shard", "slot").withColumn("_row", F.monotonically_increasing_id())
    numbered = materialize(kept, "shard-rows")
    placed = hilbert_shards(numbered, n_shards, bits, carry=("_row",)).select("_row", "hilbert", "shard", "slot")
    joined = numbered.join(placed, "_row").drop("_row")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
