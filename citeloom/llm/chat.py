"""Chat formatting as prefix trees: shared turns are emitted once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, broadcast_if_small, materialize, table
from citeloom.shipping import ship_package

#: The template of a turn. Both marks start with the opening that texts escape.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|done|>"
LEARNT_ROLE = "assistant"
#: Control strings of common templates; a backslash is put behind the first character, backslashes are doubled.
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text in it)."""
    before = f"{OPEN}{escape(role)}{MIDDLE}"
    said = escape(text)
    return f"{before}{said}{CLOSE}", len(before), len(before) + len(said)


def read_turn(body: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not body.startswith(OPEN) or not body.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    role, _, said = body[len(OPEN) : -len(CLOSE)].partition(MIDDLE)
    return unescape(role), unescape(said)


_CHAIN = "conv_id long, i long, node binary, parent binary, role string, body string, learn_from long, learn_to long, position long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, each with the digest of all turns so far.

    Only the state of the conversation at hand is held, whatever its length.
    """
    at, i, parent, position = object(), 0, b"", 0
    for b in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*[b.column(k).to_pylist() for k in ("conv_id", "role", "text")], strict=True):
            if conv != at:
                at, i, parent, position = conv, 0, b"", 0
            body, start, end = format_turn(role, text)
            node = blake2b(parent + body.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            learn = role == LEARNT_ROLE
            out.append((conv, i, node, parent, role, body, start if learn else 0, end if learn else 0, position))
            i, parent, position = i + 1, node, position + len(body)
        yield _batch(out, _CHAIN)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_KEYED = "conv_id long, i long, node binary, key binary, size long"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-first keys: the digests taken where the tree branches, from the root on."""
    at, key = object(), b""
    for b in batches:
        out = []
        for conv, i, node, branch, size in zip(*[b.column(k).to_pylist() for k in ("conv_id", "i", "node", "branch", "size")], strict=True):
            if conv != at:
                at, key = conv, b""
            if branch:
                key += node
            out.append((conv, i, node, key, size))
        yield _batch(out, _KEYED)


_SPANNED = "conv_id long, i long, node binary, start long, span_starts array<long>, span_ends array<long>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each turn the packed intervals of its ancestors, neighbours joined."""
    at, starts, ends = object(), [], []
    for b in batches:
        out = []
        for conv, i, node, start, size in zip(*[b.column(k).to_pylist() for k in ("conv_id", "i", "node", "start", "size")], strict=True):
            if conv != at:
                at, starts, ends = conv, [], []
            out.append((conv, i, node, start, list(starts), list(ends)))
            if ends and ends[-1] == start:
                ends[-1] = start + size
            else:
                starts.append(start)
                ends.append(start + size)
        yield _batch(out, _SPANNED)


def _by_conversation(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *more)


def prefix_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packed, index): the tree's turns once each, and where each conversation's turns are.

    ``packed`` has a row for each distinct turn after the same turns: start
    (its place in the one depth-first sequence of all trees, in code points),
    body (the formatted turn), role, position (the position id of its first
    code point: the length of its ancestors), learn_from and learn_to (the part
    of body under the loss mask) and attends (intervals of the sequence that
    hold its ancestors; within the body attention is causal). ``index`` has
    conv_id, i and start for each turn.

    Turns are ordered by (turn, role, text), so that turns with one number
    have a defined order. Null role or text count as empty; a null turn comes
    first; rows with a null conv_id form one conversation; a very long text is
    one turn and formatted whole; repeated rows are turns of their own; an
    empty table gives empty tables; other columns, whatever their names, are
    not read.

    Conversations are streamed in sorted order and never held as a whole.
    Distinct turns are aggregated before they are shuffled, so a first turn
    that all conversations share is one row for each task.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    turns = materialize(_by_conversation(rows, "turn", "role", "text").mapInArrow(_chain, _CHAIN), "chat-turns")
    size = F.length("body").cast("long")
    nodes = turns.groupBy("node").agg(F.min("parent").alias("parent"), F.min(F.struct("conv_id", "i")).alias("owner"), F.min(size).alias("size"))
    nodes = materialize(nodes, "chat-nodes")
    branches = nodes.where(F.length("parent") > 0).groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.lit(True).alias("many"))
    light = turns.select("conv_id", "i", "node", "parent", size.alias("size")).join(broadcast_if_small(materialize(branches, "chat-branches")), "parent", "left")
    light = light.withColumn("branch", F.col("many").isNotNull() | (F.length("parent") == 0))
    keyed = _by_conversation(light.select("conv_id", "i", "node", "branch", "size"), "i").mapInArrow(_keys, _KEYED)
    owners = nodes.select(F.col("owner.conv_id").alias("conv_id"), F.col("owner.i").alias("i"), "node")
    owned = _of_owner(keyed, owners)
    placed = materialize(_running_start(materialize(owned.select("node", "key", "i", "size"), "chat-keys")), "chat-places")
    index = materialize(_by_conversation(turns.select("conv_id", "i", "node").join(placed, "node"), "i").mapInArrow(_spans, _SPANNED), "chat-index")
    mine = _of_owner(index, owners)
    attends = F.arrays_zip(F.col("span_starts").alias("start"), F.col("span_ends").alias("end"))
    mine = mine.select("conv_id", "i", "start", attends.alias("attends"))
    full = turns.withColumnRenamed("conv_id", "_c").withColumnRenamed("i", "_i")
    packed = full.join(mine, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_i") == F.col("i")))
    packed = packed.select("start", "body", "role", "position", "learn_from", "learn_to", "attends")
    return packed, index.select("conv_id", "i", "start")


def _of_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """The one row of each node that belongs to the conversation that owns it."""
    right = owners.select(F.col("conv_id").alias("_c"), F.col("i").alias("_i"))
    return rows.join(right, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("i") == F.col("_i")), "left_semi")


def _running_start(owned: DataFrame) -> DataFrame:
    """(node, start, size): exclusive running sums of size in the order of (key, i)."""
    ranged = owned.repartitionByRange("key", "i").sortWithinPartitions("key", "i").mapInArrow(_sums, _SUMMED)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "chat-sums")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(totals), "part").select("node", (F.col("within") + F.col("_before")).alias("start"), "size")


_SUMMED = "node binary, within long, size long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        out = []
        for node, size in zip(b.column("node").to_pylist(), b.column("size").to_pylist(), strict=True):
            out.append((node, total, size))
            total += size
        yield _batch(out, _SUMMED)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = object(), None

    def result() -> tuple:
        n, turns, loss_n, loss, chars = state
        return at, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

    for b in batches:
        out = []
        for conv, body, lo, hi in zip(*[b.column(k).to_pylist() for k in ("conv_id", "body", "learn_from", "learn_to")], strict=True):
            if conv != at:
                if state:
                    out.append(result())
                at, state = conv, [0, sha256(), 0, sha256(), 0]
            role, text = read_turn(body)
            learnt = unescape(body[lo:hi])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[2] += len(learnt)
            state[3].update(learnt.encode("utf-8", "surrogatepass"))
            state[4] += len(body)
        yield _batch(out, _DIGEST)
    if state:
        yield _batch([result()], _DIGEST)


def read_back(packed: DataFrame, index: DataFrame) -> DataFrame:
    """Digests of each conversation from the packed turns alone."""
    ship_package(packed.sparkSession)
    turns = index.join(packed.select("start", "body", "learn_from", "learn_to"), "start")
    return _by_conversation(turns.select("conv_id", "i", "body", "learn_from", "learn_to"), "i").mapInArrow(_digests, _DIGEST)


def op6_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    packed, index = prefix_trees(rows)
    return read_back(packed, index)


#: The same digests from the table itself, with the template's lengths.
OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 24 + length(role) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]'))
              + length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]')) AS n
  FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
