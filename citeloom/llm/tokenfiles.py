"""Token ids in flat binary files whose document boundaries are Elias-Fano encoded."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, materialize, table
from citeloom.scratch import scratch_path
from citeloom.shipping import ship_package

END_ID = 1
#: A file of ids holds about this many bytes.
SHARD_BYTES = 256 << 20
#: Every so many boundaries the select structure notes, in 32 bits, where the upper bits stand.
SAMPLE = 256
#: Words whose ids a Python worker remembers, and the longest of them.
KNOWN_WORDS, KNOWN_LENGTH = 1_000_000, 64
#: Texts go to the tokenizer in pieces of about this many characters, files are read in pieces of about this many ids.
_PIECE, _READ = 1 << 18, 1 << 20
#: Rows that are encoded at once, and the bytes of them that are taken apart into words at once.
_ROWS, _TEXT_BYTES = 1000, 4 << 20
_BLANK = np.isin(np.arange(256), list(b" \t\n\r"))
#: As it stands in a tokenizers file: letters are parts of words, and so is what is neither letter, digit nor white space.
_RUNS = r'|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"'
#: Such marks behind letters are a part of their own (but not the apostrophe, which may go with letters).
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

_HEAD = struct.Struct("<QqBxxxxxxxQ")  # values, offset, low bits, bits of the upper part


class EliasFano:
    """A non-decreasing sequence of whole numbers in about 2 + log2(range / length) bits each.

    The low bits stand side by side; the upper parts are a bit vector with a 1
    for each value, as many 0s before it as its upper part says. ``select``
    finds the i-th 1 from a sampled position by counting bits in words.
    """

    def __init__(self, data: bytes) -> None:
        self.n, self.offset, self.low, bits = _HEAD.unpack_from(data)
        at = _HEAD.size
        lows, highs, samples = self.sizes(self.n, self.low, bits)
        self._lows = np.frombuffer(data, np.uint8, lows, at)
        self._highs = np.frombuffer(data, np.uint8, highs, at + lows)
        self._samples = np.frombuffer(data, "<u4", samples, at + lows + highs)
        self.nbytes = at + lows + highs + 4 * samples

    @staticmethod
    def sizes(n: int, low: int, bits: int) -> tuple[int, int, int]:
        """Bytes of low bits and of upper bits (whole words, and one that is empty), and the number of samples."""
        return (n * low + 7) // 8 + 8, 8 * (bits // 64 + 2), n // SAMPLE + 1

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        """``values``: 64-bit integers in ascending order."""
        n = len(values)
        offset = int(values[0]) if n else 0
        above = (values.astype(np.int64).view(np.uint64) - np.uint64(offset % (1 << 64))) if n else np.zeros(0, np.uint64)
        low = max(0, (int(above[-1]) // n).bit_length() - 1) if n else 0
        upper = (above >> np.uint64(low)).astype(np.int64)
        ones = upper + np.arange(n)
        bits = int(ones[-1]) + 1 if n else 0
        if bits >= 1 << 32:
            raise ValueError("too many boundaries for one file: its select structure has 32-bit positions")
        lows, highs, _ = cls.sizes(n, low, bits)
        vector = np.zeros(highs, np.uint8)
        np.bitwise_or.at(vector, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        packed = np.zeros(lows, np.uint8)
        for b in range(low):
            mine = np.flatnonzero((above >> np.uint64(b)) & np.uint64(1)) * low + b
            np.bitwise_or.at(packed, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        samples = np.full(n // SAMPLE + 1, bits, "<u4")
        samples[: -(-n // SAMPLE)] = ones[::SAMPLE]
        return _HEAD.pack(n, offset, low, bits) + packed.tobytes() + vector.tobytes() + samples.tobytes()

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        at = i * self.low
        word = int.from_bytes(self._lows[at >> 3 : (at >> 3) + 16].tobytes(), "little")
        return word >> (at & 7) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        words = self._highs.view("<u8")
        w = at >> 6
        word = int(words[w]) >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left -= ones
            w += 1
            word = int(words[w])
        for _ in range(left):
            word &= word - 1
        position = 64 * w + (word & -word).bit_length() - 1
        return self.offset + ((position - i) << self.low | self._low(i))

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The values from ``start`` to ``stop``, from the bits between two samples."""
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = start // SAMPLE, min(-(-stop // SAMPLE), len(self._samples) - 1)
        begin = int(self._samples[first])
        end = int(self._samples[last]) if last * SAMPLE >= stop else 8 * len(self._highs)
        bits = np.unpackbits(self._highs[begin >> 3 : (end >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits) + (begin >> 3 << 3)
        ones = ones[ones >= begin][start - first * SAMPLE :][: stop - start]
        value = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            at = start * self.low
            raw = np.unpackbits(self._lows[at >> 3 : (stop * self.low >> 3) + 1], bitorder="little")
            raw = raw[at & 7 :][: (stop - start) * self.low].reshape(-1, self.low).astype(np.uint64)
            for b in range(self.low):
                value |= raw[:, b] << np.uint64(b)
        return (value + np.uint64(self.offset % (1 << 64))).view(np.int64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut_at(data: np.ndarray, ends: np.ndarray, start: int) -> int:
    """Where a piece of the texts in ``data`` (they end at ``ends``) that begins at ``start`` may end: about _TEXT_BYTES on, and not inside a word."""
    size = _TEXT_BYTES
    while start + size < len(data):
        stop = start + size
        blanks = np.flatnonzero(_BLANK[data[start:stop]])
        edge = int(ends[np.searchsorted(ends, stop, side="right") - 1]) if ends[0] <= stop else 0
        if (cut := max(start + int(blanks[-1]) + 1 if len(blanks) else 0, edge)) > start:
            return cut
        size *= 2
    return len(data)


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 text, and where they begin; ``edges`` (inside of it) divide words as ASCII white space does."""
    blank = _BLANK[data]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    first[edges] = ~blank[edges]
    last[edges - 1] = ~blank[edges - 1]
    begins = np.flatnonzero(first)
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - begins, out=offsets[1:])
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[~blank])), begins


def _pieces(words: list[str], size: int) -> Iterator[list[str]]:
    """``words`` in lists of about ``size`` characters."""
    start = 0
    while start < len(words):
        stop, n = start, 0
        while stop < len(words) and (n < size or stop == start):
            n += len(words[stop]) + 1
            stop += 1
        yield words[start:stop]
        start = stop


def _parts(word: str) -> int:
    """1 for letters, 2 for letters (of scripts that are in every version of Unicode) with ASCII marks behind them, else 0."""
    if word.isalpha():
        return 1
    letters = word.rstrip(_MARKS)
    return 2 if letters.isalpha() and max(letters) < "\u0530" else 0


class WordEncoder:
    """Encodes texts with the tokenizers library; with ``words_apart``, each word once.

    Vocabularies that drop white space and never join across it give a text
    the ids of its words in turn. Words are divided at ASCII white space only;
    what else a tokenizer divides at lies within them. Texts become numbers of
    words, whose ids are gathered. Words not yet known are encoded together, and
    their ids told apart by their offsets. Where the tokenizer divides words
    into runs of letters and of marks, and ids say that they end a run, those
    of letters, or of letters with marks behind them, are told apart by
    counting such ids instead, which costs less; if there are not as many as
    expected, by offsets again.
    """

    def __init__(self, config: str, end_id: int, words_apart: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of a job are parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id)
        self.end = np.array([end_id], self.dtype)
        self.words_apart = words_apart
        self.ending = self._endings(config) if words_apart else None
        self.known: dict[str, bytes] = {}

    def _endings(self, config: str) -> np.ndarray | None:
        """Whether an id ends a run of letters or marks, by id; None if the tokenizer has no such runs or its ids don't say."""
        from tokenizers.pre_tokenizers import ByteLevel

        suffix, vocabulary = json.loads(config)["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=False)
        if _RUNS not in config or not suffix or not all(c + suffix in vocabulary for c in ByteLevel.alphabet()):
            return None
        ending = np.zeros(max(vocabulary.values()) + 1, bool)
        ending[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ending

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}

        def add(some: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
            data, at = ids.astype(self.dtype).tobytes(), (cuts * self.dtype.itemsize).tolist()
            out.update((w, data[a:b]) for w, a, b in zip(some, at[:-1], at[1:], strict=True))

        counted = {w: n for w in words if (n := _parts(w))} if self.ending is not None else {}
        others = [w for w in words if w not in counted]
        for some in _pieces(list(counted), max(1, _PIECE >> 4)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.int64)
            last = np.cumsum([counted[w] for w in some])
            ends = np.flatnonzero(self.ending[ids]) + 1 if ids.max(initial=0) < len(self.ending) else ids[:0]
            if len(ends) == last[-1]:
                add(some, ids, np.append(0, ends[last - 1]))
            else:
                others += some
        for some in _pieces(others, _PIECE):
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0, *[len(w) + 1 for w in some]])
            add(some, np.array(found.ids, dtype=np.int64), np.searchsorted(np.array([a for a, _ in found.offsets], dtype=np.int64), begins))
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        ids = list(map(self.known.get, words))
        learnt = self._learn([w for w, v in zip(words, ids, strict=True) if v is None])
        self.known.update((w, v) for w, v in learnt.items() if len(w) <= KNOWN_LENGTH)
        return [learnt[w] if v is None else v for w, v in zip(words, ids, strict=True)]

    def flat(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts (strings) one after another, the end id after each, in pieces; and where in a piece texts end."""
        if not self.words_apart:
            for t in texts:
                ids = self.tokenizer.encode(t.as_py() or "", add_special_tokens=False).ids
                yield np.append(np.array(ids, self.dtype), self.end), np.array([len(ids) + 1])
            return
        if not len(texts):
            return
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        ends = bounds[1:] - bounds[0]
        start = done = 0
        while done < len(ends):
            stop = _cut_at(data, ends, start)
            ended = ends[done : done + int(np.searchsorted(ends[done:], stop, side="right"))] - start
            words, begins = _words(data[start:stop], ended[(ended > 0) & (ended < stop - start)])
            found = words.dictionary_encode()
            ids = self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist())
            known = np.append(np.frombuffer(b"".join(ids), self.dtype), self.end)
            lengths = np.array([*map(len, ids), self.dtype.itemsize]) // self.dtype.itemsize
            places = np.searchsorted(begins, ended)
            codes = np.insert(found.indices.to_numpy(), places, len(ids))  # the end id is a word behind each text
            n = lengths[codes]
            upto = np.cumsum(n)
            at = np.repeat((np.cumsum(lengths) - lengths)[codes] - (upto - n), n)
            at += np.arange(len(at))
            yield known[at], upto[places + np.arange(len(places))]
            start, done = stop, done + len(ended)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, little-endian."""
        ids, ends, total = [], [], 0
        for piece, stops in self.flat(pa.array(texts, pa.large_string())):
            ids.append(piece)
            ends += (stops + total).tolist()
            total += len(piece)
        joined = np.concatenate(ids) if ids else self.end
        return [joined[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


def id_type(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(config: str, end_id: int, words_apart: bool) -> WordEncoder:
    key = hash(config), end_id, words_apart
    if key not in _ENCODERS:  # a worker that is used again knows its words
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(config, end_id, words_apart)
    return _ENCODERS[key]


class _ShardWriter:
    """One pair of files of a task; nothing refers to those of an attempt that fails."""

    def __init__(self, folder: str, number: int) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard = (TaskContext.get().partitionId() << 20) + number
        self.name = f"{self.shard:012d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.ids")
        self.nulls = self.total = self.bytes = 0
        self.docs: list[np.ndarray] = []
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]

    def add(self, docs: pa.Array, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        self.nulls += docs.null_count
        self.docs.append(docs.drop_null().to_numpy())
        for ids, ends in pieces:
            self.ends.append(ends + self.total)
            self.total += len(ids)
            self.bytes += ids.nbytes
            self.out.write(ids.tobytes())

    def close(self) -> pa.RecordBatch:
        self.out.close()
        bounds, docs = EliasFano.encode(np.concatenate(self.ends)), EliasFano.encode(np.concatenate(self.docs))
        with self.fs.open_output_stream(f"{self.folder}/{self.name}.bounds") as out:
            out.write(struct.pack("<Q", self.nulls) + bounds + docs)
        row = [self.shard, self.name, sum(map(len, self.ends)) - 1, self.total]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["shard", "name", "n_docs", "n_tokens"])


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, shard_bytes: int, encoder: tuple) -> Iterator[pa.RecordBatch]:
    """Encodes the sorted rows of a task and appends them to files, a new one whenever the last is full."""
    encode = _encoder(*encoder)
    writer, number = None, 0
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            writer = writer or _ShardWriter(folder, number)
            writer.add(part.column(0), encode.flat(part.column(1)))
            if writer.bytes >= shard_bytes:
                yield writer.close()
                writer, number = None, number + 1
    if writer:
        yield writer.close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, words_apart: bool | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of all texts of ``docs`` (doc_id, text), with ``end_id`` after each, under ``path``; returns the manifest.

    Each shard has a flat file of ids (16 bits where the vocabulary allows it)
    in ascending order of doc_id, and a file with its document boundaries and
    doc_ids, both Elias-Fano encoded. The manifest, a table under
    ``path/manifest``, names the files and holds the documents and ids before
    each shard. ``path`` is a folder that all executors reach. The texts are
    sorted by sampled ranges of doc_id, and encoded by the task that writes
    them, so ids are neither shuffled nor kept elsewhere. A task that is run
    again writes new files, and the manifest names those of the attempt that
    was committed.

    A null text is an empty one; null ids come first; rows with equal ids are
    ordered by a hash of the text, and repeated rows may go to several tasks.
    Very long texts are encoded whole. An empty table makes an empty manifest;
    other columns, whatever their names, are not read.

    ``tokenizer`` is the path of a tokenizers file on the driver; ``words_apart``
    says that its ids do not depend on the neighbouring words (true of the
    default vocabulary), so that each word needs to be encoded once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    words_apart = tokenizer is None if words_apart is None else words_apart
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        config = spark.sparkContext.broadcast(file.read())
    filesystem, folder = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, "_row").sortWithinPartitions(*order)
    written = ordered.select("doc_id", "text").mapInArrow(lambda it: _write_shards(it, path, shard_bytes, (config.value, end_id, words_apart)), "shard long, name string, n_docs long, n_tokens long")
    written = materialize(written, "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n.removeprefix('n_')}_before") for n in ("n_docs", "n_tokens")]
    width = id_type(_vocabulary(config.value), end_id).itemsize
    manifest = written.select("*", *starts, F.lit(width).alias("width")).coalesce(1)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def _vocabulary(config: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(config).get_vocab_size(with_added_tokens=True)


class Shard:
    """One pair of files: ``len``, ``bounds.select`` and ``ids`` give any document without reading the others."""

    def __init__(self, path: str, row: dict) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(path)
        self.row, self.dtype = row, np.dtype(f"<u{row['width']}")
        with self.fs.open_input_file(f"{self.folder}/{row['name']}.bounds") as file:
            data = file.read()
        self.nulls = struct.unpack_from("<Q", data)[0]
        self.bounds = EliasFano(data[8:])
        self.docs = EliasFano(data[8 + self.bounds.nbytes :])
        self.file = self.fs.open_input_file(f"{self.folder}/{row['name']}.ids")

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place to another."""
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * w, start * w), self.dtype)

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        nulls = max(0, min(stop, self.nulls) - start)
        return [None] * nulls + self.docs.slice(start + nulls - self.nulls, stop - self.nulls).tolist()


class TokenFiles:
    """What ``write_token_files`` wrote, document by document, for a reader without Spark."""

    def __init__(self, path: str) -> None:
        filesystem, folder = pafs.FileSystem.from_uri(path)
        rows = parquet.read_table(f"{folder}/manifest", filesystem=filesystem).to_pylist()
        self.path, self.rows = path, sorted(rows, key=lambda r: r["shard"])
        self.before = [r["docs_before"] for r in self.rows]
        self._open: tuple[int, Shard] | None = None

    def __len__(self) -> int:
        return self.before[-1] + self.rows[-1]["n_docs"] if self.rows else 0

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document in the order of doc_id."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        s = int(np.searchsorted(self.before, i, side="right")) - 1
        if self._open is None or self._open[0] != s:
            self._open = s, Shard(self.path, self.rows[s])
        return self._open[1].ids(i - self.before[s])


def _read(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    for b in batches:
        for row in b.to_pylist():
            shard = Shard(path, row)
            done = 0
            while done < len(shard):
                ends = shard.bounds.slice(done, min(len(shard), done + 8192) + 1)
                take = max(1, int(np.searchsorted(ends, ends[0] + _READ, side="right")) - 1)
                take = min(take, len(ends) - 1)
                ends = ends[: take + 1]
                at = (ends - ends[0]).tolist()
                crcs, ids = [], None
                if with_ids or at[-1] <= _READ:
                    ids = shard.span(int(ends[0]), int(ends[-1])).astype("<u4")
                    crcs = [crc32(ids[a:z].tobytes()) for a, z in zip(at[:-1], at[1:], strict=True)]
                else:  # one very long document
                    crc = 0
                    for a in range(int(ends[0]), int(ends[-1]), _READ):
                        crc = crc32(shard.span(a, min(a + _READ, int(ends[-1]))).astype("<u4").tobytes(), crc)
                    crcs = [crc]
                columns = [pa.array(shard.doc_ids(done, done + take), pa.int64()), pa.array(ends[:-1] + row["tokens_before"], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += take


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document under ``path``, read back from the files."""
    ship_package(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return manifest.repartition(files, "shard").mapInArrow(lambda it: _read(it, path, ids), schema)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, ids=False)
