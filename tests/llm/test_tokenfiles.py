import random
from zlib import crc32

import numpy as np
import pytest

from citeloom.llm import tokenfiles as K
from citeloom.llm.tokenfiles import EliasFano, Shard, TokenFiles, WordEncoder, default_tokenizer, op13_token_files, read_token_files, write_token_files

ODD = ["a\x1cb c\x85d\xa0e f　g ́x ͅ 'S 'll it's<|endoftext|>x <|startoftext|> ΣΑΣ ΣΑΣ.   q​z 12 ½ Ǆ İ ﬁ", "\x1c \x1d", "  ", "", None, "é \n\r\t É\x0bx\x0cy z", "日本語 テスト<|endoftext|>", "🙂🙂 👩‍👩‍👧", "don't we'LL"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def brute(rows, plain):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text)
        out.append((doc, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 1 << 40], [-(2**63), 0, 2**63 - 1], list(range(1000)), [i * i * 1000 for i in range(3000)], [-7] * 600 + [9] * 600])
def test_elias_fano_round_trip(values):
    data = EliasFano.encode(np.array(values, dtype=np.int64))
    back = EliasFano(data)
    assert len(back) == len(values) and back.nbytes == len(data)
    assert [back.select(i) for i in range(len(values))] == values
    assert back.slice(0, len(values)).tolist() == values
    rng = random.Random(1)
    for _ in range(30):
        a, b = sorted(rng.randint(0, len(values)) for _ in range(2))
        assert back.slice(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 800, 100_000))
    bits = 8 * len(EliasFano.encode(values)) / len(values)
    assert bits < 2 + np.log2(values[-1] / len(values)) + 0.3  # 32 bits every 256 values, and the head


def test_words_apart_gives_the_ids_of_whole_texts(plain, docs):
    texts = [*ODD, *[r.text for r in docs.select("text").collect()], "x" * 3000 + " y" * 200_000, "".join(chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000)]
    with open(default_tokenizer(), encoding="utf-8") as f:
        encoder = WordEncoder(f.read(), 1, True)
    for _ in range(2):  # the second time with known words
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder(texts)] == [plain(t) for t in texts]


def test_few_known_words(plain, monkeypatch):
    monkeypatch.setattr(K, "KNOWN_WORDS", 3)
    monkeypatch.setattr(K, "_PIECE", 10)
    with open(default_tokenizer(), encoding="utf-8") as f:
        encoder = WordEncoder(f.read(), 1, True)
    for text in ["one two three four", "five six seven", "one two", "z" * 200]:
        assert np.frombuffer(encoder([text])[0], "<u2").tolist() == plain(text)


def test_odd_rows_and_both_readers(spark, plain, tmp_path):
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD * 4)] + [(None, "no id"), (None, None), (7_000_000_000, "far"), (-(2**62), "low")] + [(2, "copy of it")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS _tie", "'x' AS shard").repartition(5)
    path = f"file://{tmp_path}/out"
    manifest = write_token_files(df, path, shard_bytes=500)
    assert manifest.count() > 1
    got = read_token_files(spark, path).orderBy("start").collect()
    want = brute(rows, plain)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((d, n, c) for d, _, n, c in want if d is not None)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id for r in got] == [w[0] for w in want]
    local = TokenFiles(path)
    assert len(local) == len(rows)
    for i in random.Random(2).sample(range(len(rows)), 60):
        assert local.ids(i).tolist() == got[i].ids
        assert crc32(np.array(got[i].ids, "<u4").tobytes()) == got[i].ids_crc32


def test_long_documents_are_read_in_pieces(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "_READ", 50)
    rows = [(1, "ab " * 400), (2, "c"), (3, "")]
    path = f"file://{tmp_path}/out"
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    import pyarrow as pa

    read = [t for row in sorted(manifest.collect(), key=lambda r: r.shard) for b in K._read(iter([pa.RecordBatch.from_pylist([row.asDict()])]), path, False) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert read == brute(rows, plain)


def test_empty_table_and_wide_ids(spark, plain, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert write_token_files(empty, f"file://{tmp_path}/a").count() == 0
    assert read_token_files(spark, f"file://{tmp_path}/a").collect() == []
    assert len(TokenFiles(f"file://{tmp_path}/a")) == 0
    manifest = write_token_files(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), f"file://{tmp_path}/b", end_id=70_000)
    row = manifest.first().asDict()
    assert row["width"] == 4
    assert Shard(f"file://{tmp_path}/b", row).ids(0).tolist() == [*plain("hello there")[:-1], 70_000]


def test_whole_texts_without_words_apart(spark, plain, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/w", words_apart=False)
    assert [tuple(r) for r in read_token_files(spark, f"file://{tmp_path}/w", ids=False).orderBy("start").collect()] == brute(rows, plain)


def test_query_equals_brute_force(spark, sf, plain, docs):
    got = [tuple(r) for r in op13_token_files(spark, sf).orderBy("start").collect()]
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], plain)


class Counted:
    """A tokenizer whose calls are counted."""

    def __init__(self, inner):
        self.inner, self.calls = inner, []

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.inner, name)


def test_words_of_letters_need_no_offsets(plain, docs):
    with open(default_tokenizer(), encoding="utf-8") as f:
        encoder = WordEncoder(f.read(), 1, True)
    encoder.tokenizer = Counted(encoder.tokenizer)
    text = "Plain words, of letters. Même là (not) этот; 日本語 ΣΑΣ ***"
    fit = " ".join(w for w in text.split() if w not in ("(not)", "***"))
    assert np.frombuffer(encoder([fit])[0], "<u2").tolist() == plain(fit)
    assert "encode" not in encoder.tokenizer.calls
    assert np.frombuffer(encoder([text])[0], "<u2").tolist() == plain(text) and "encode" in encoder.tokenizer.calls
    words = list({w for r in docs.select("text").collect() for w in (r.text or "").split()})
    assert sum(map(bool, map(K._parts, words))) > 0.9 * len(words)


@pytest.mark.parametrize("ending", [None, False, True])
def test_without_ids_that_end_runs(plain, ending):
    texts = [*ODD, "İ, İİ aͅ. é, ｱ! x²; ªº a<|endoftext|> <|endoftext|>, foo</w> bar</w>, 's 'll, can't."]
    with open(default_tokenizer(), encoding="utf-8") as f:
        encoder = WordEncoder(f.read(), 1, True)
    encoder.ending = None if ending is None else np.full_like(encoder.ending, ending)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_texts_are_taken_apart_in_pieces(plain, monkeypatch, size):
    monkeypatch.setattr(K, "_TEXT_BYTES", size)
    import pyarrow as pa

    with open(default_tokenizer(), encoding="utf-8") as f:
        encoder = WordEncoder(f.read(), 1, True)
    for texts in ([], [None], ["", None, " \n "], ["", *ODD, "y" * 200, "", " a", "b ", "c", "d", None]):
        for array in (pa.array(texts, pa.string()), pa.array(["first", *texts, "last"], pa.large_string()).slice(1, len(texts))):
            pieces = list(encoder.flat(array))
            before = np.cumsum([0, *[len(ids) for ids, _ in pieces]])
            ends = [0, *[int(e + b) for (_, ends), b in zip(pieces, before, strict=False) for e in ends]]
            ids = [i for ids, _ in pieces for i in ids.tolist()]
            assert [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)] == [plain(t) for t in texts] and ends[-1] == len(ids)
