import json
import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.vectors import cosine, embed, from_literal, hashing_embedder, rounded, vector_literal
from citeloom.plans.queries import ORACLES, QUERIES


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


LONG = {"We": [0, 8], "sort": [1], "pebbles": [2], "by": [3, 6], "weight,": [4], "then": [5], "hue;": [7], "keep": [9], "both.": [10]}
TEXT = "We sort pebbles by weight, then by hue; We keep both."
ABSTRACTS = [
    (json.dumps(LONG), TEXT),
    ("{}", None), (None, None), ("   ", None), ('{"cut": [0', None), ('["a", [0]]', None), ("-7.5", None), ("false", None),
    ('{"so":[1,4],"or":[2],"not":[3],"be":[0]}', "be so or not so"),
    ('{"later":[1],"sooner":[0]}', "sooner later"),
    ('{"open":[2],"end":[9]}', "open end"),
    ('{"a":[1.5],"b":[0]}', "b"), ('{"a":[-1],"b":[2]}', "b"), ('{"a":[true],"b":[0]}', "b a"), ('{"a":["0"],"b":[1]}', "b"), ('{"a":[null],"b":[1]}', "b"), ('{"a":[[0]],"b":[1]}', "b"),
    ('{"a":"x","b":[1]}', "b"), ('{"a":"[5]","b":[1]}', "b"), ('{"a":null,"b":[1]}', "b"),
    ('{"a":[99999999999],"b":[1]}', "b a"), ('{"a":[0],"a":[1],"b":[0]}', "b a"), ('{"a":[0],"b":[0]}', "b"), ('{"":[0],"b":[1]}', "b"), ('{"":[0]}', None),
    ('{"a":[0]} x', None), ('{"a":[0],}', None), ("{'a':[0]}", None),
]


def test_abstracts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ABSTRACTS)], "i int, t string")
    got = {r.i: r.a for r in rows.select("i", tx.reconstruct_abstract("t").alias("a")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(ABSTRACTS)}


def test_ids_slugs_titles(spark):
    cases = {"https://x.example/W123": "W123", "W123": "W123", "a/": "", "": "", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", tx.short_id("c").alias("s")).collect()
    assert {r.c: r.s for r in rows} == cases
    assert one(spark, tx.slug(F.lit("a b c"))) == "a_b_c"
    assert one(spark, tx.truncated(F.lit("x" * 18))) == "x" * 18 and one(spark, tx.truncated(F.lit("y" * 19))) == "y" * 17 + "…"
    assert one(spark, tx.https_url(F.lit("s3://name/a/b.parquet"))) == "https://name.s3.amazonaws.com/a/b.parquet"


def brute_chunks(text, size, overlap):
    out, start = [], 0
    while text and text.strip() and start < len(text):
        if piece := text[start : start + size].strip():
            out.append(piece)
        if start + size >= len(text):
            break
        start += size - overlap
    return out


def test_chunks(spark):
    texts = [None, "", "  \n ", "short", "word " * 500, "x" * 1500, "x" * 1501, "é " * 3000, " " * 4000 + "end", "a" + " " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((1500, 100), (800, 100), (10, 3), (7, 0)):
        got = {r.i: r.c for r in rows.select("i", tx.chunks(F.col("t"), size, overlap).alias("c")).collect()}
        assert got == {i: brute_chunks(t, size, overlap) for i, t in enumerate(texts)}
    for size, overlap in ((0, 0), (5, 5), (5, 6)):
        with pytest.raises(ValueError):
            tx.chunks(F.lit("x"), size, overlap)


def test_indexes_of_any_text(spark):
    """Abstracts rebuilt by batch are those of the plain function, for odd words and broken JSON too."""
    rng = random.Random(6)
    words = ["déjà", "quo\"te", "back\\slash", "new\nline", "s", "[1]", "{", "a:b", "tab\t", "\u2003", "\U0001f600", "x"]
    whole = [{w: sorted(rng.sample(range(k * 50, k * 50 + 50), rng.randrange(1, 5))) for k, w in enumerate(rng.sample(words, rng.randrange(1, len(words))))} for _ in range(60)]
    other = ['{"a": [0], "b": [0]}', '{"a": [0], "a": [1]}', '{"a": {"b": [1]}}', '{"a": [null], "b": [4]}', '"s"', '{"a": [0]} x', '{"a": [0]} {"b": [1]}', '{"a": [01]}', '{"a\nb": [0]}']
    rows = spark.createDataFrame([(t,) for t in [*(json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in whole), *other, None]], "t string")
    got = rows.select("t", tx.reconstruct_abstract(F.col("t")).alias("a")).collect()
    assert all(r.a == tx.rebuild_abstract(r.t) for r in got)
    expected = [" ".join(w for _, w in sorted((p, w) for w, places in x.items() for p in places)).strip() for x in whole]
    assert [r.a for r in got[: len(whole)]] == [x or None for x in expected]


def test_payloads_as_variants(spark):
    texts = ['{"a": {"b": 3}, "c": "x"}', '{"a": {"b": "three"}, "c": null}', '{"c": [1]}', "[1, 2]", "nope", "", None, '{"a": 1, "a": 2}']
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, payload string, more string")
    got = tx.payload_fields(rows, {"b": ("$.a.b", "long"), "c": ("$.c", "string")})
    assert got.columns == ["i", "more", "b", "c"]
    assert {(r.i, r.b, r.c) for r in got.collect() if r.i < 2} == {(0, 3, "x"), (1, None, None)}
    assert all((r.b, r.c) == (None, None) for r in got.collect() if r.i > 2)
    opened = {(r.i, r.field, r.kind, r.json) for r in tx.payload_entries(rows, "i").collect()}
    assert opened == {(0, "a", "OBJECT<b: BIGINT>", '{"b":3}'), (0, "c", "STRING", '"x"'), (1, "a", "OBJECT<b: STRING>", '{"b":"three"}'), (1, "c", "VOID", "null"), (2, "c", "ARRAY<BIGINT>", "[1]")}


def test_batches_and_filters(spark):
    for n in range(12):
        for size in (1, 3, 5, 20):
            parts = list(tx.in_batches([f"p{i}" for i in range(n)], size))
            assert [x for p in parts for x in p] == [f"p{i}" for i in range(n)]
            assert all(len(p) == size for p in parts[:-1]) and all(0 < len(p) <= size for p in parts)
    rows = tx.batched(spark.range(5).repartition(3), "id", 2).orderBy("batch").collect()
    assert [(r.batch, r.ids) for r in rows] == [(0, [0, 1]), (1, [2, 3]), (2, [4])]
    assert one(spark, tx.or_filter("ids", F.array(F.lit("https://x.example/W1"), F.lit("W2")))) == "ids:W1|W2"
    with pytest.raises(PySparkException):
        one(spark, tx.or_filter("ids", F.array().cast("array<string>")))


def test_batches_of_many_wide_ids(spark):
    n = 300_000
    ids = spark.range(n).select(F.concat(F.repeat(F.lit("https://x.example/"), 9), F.lpad(F.col("id").cast("string"), 9, "0")).alias("id"))
    got = tx.batched(ids.repartition(16, F.xxhash64("id")), "id", 100).select("batch", F.size("ids").alias("n"), F.substring(F.col("ids")[0], -9, 9).cast("long").alias("first"))
    assert tuple(got.agg(F.count("*"), F.sum("n"), F.count_if(F.col("first") != F.col("batch") * 100)).first()) == (n // 100, n, 0)


def test_vectors(spark):
    v = F.array(F.lit(1.0), F.lit(-0.5), F.lit(0.0))
    assert one(spark, vector_literal(v)) == "[1.00000000,-0.50000000,0.00000000]"
    assert one(spark, vector_literal(F.array().cast("array<double>"))) == "[]" and one(spark, from_literal(F.lit("[]"))) == []
    assert one(spark, from_literal(F.lit("[1.5,-2]"))) == [1.5, -2.0]
    rng = random.Random(8)
    a, b = ([rng.gauss(0, 1) for _ in range(90)] for _ in range(2))
    want = sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    rows = spark.createDataFrame([(a, b, [0.0] * 90)], "a array<float>, b array<float>, z array<float>")
    r = rows.select(cosine(F.col("a"), F.col("a")).alias("s"), cosine(F.col("a"), F.col("b")).alias("d"), cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert abs(r.s - 1) < 1e-9 and abs(r.d - want) < 1e-6 and r.z is None
    e = embed(spark.createDataFrame([("a b",), (None,), ("a b",)], "t string"), "t", hashing_embedder).collect()
    assert e[0].embedding == e[2].embedding and sum(e[1].embedding) == 0


def test_explanations_and_replies(spark):
    cases = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\tline\n"]
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", tx.quoted(F.col("c")).alias("q")).collect()
    assert {r.c: r.q for r in rows} == {c: repr(c) for c in cases}
    replies = [
        ({"choices": [{"message": {"content": "hi"}}], "messages": [{"role": "assistant", "content": "no"}]}, "hi"),
        ({"choices": [{"message": {"content": " "}}], "messages": [{"role": "assistant", "content": "one"}, {"role": "assistant", "content": "two"}, {"role": "user", "content": "x"}]}, "two"),
        ({"output": [{"type": "message", "content": [{"text": "a"}]}, {"type": "message", "content": [{"text": " "}, {"text": "b"}, {"text": "c"}]}, {"type": "tool", "content": [{"text": "z"}]}]}, "b"),
        ({"messages": [{"role": "user", "content": "x"}]}, None), ({}, None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(replies)] + [(9, None), (10, "nope")], "i int, r string")
    got = {r.i: r.a for r in rows.select("i", tx.agent_reply(F.col("r")).alias("a")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(replies)} | {9: None, 10: None}


def test_literals_are_those_of_c(spark):
    """Halves that doubles hold exactly go to the even digit; what is no number, and nulls, as in C and SQL."""
    values = [0.103515625, -0.103515625, 0.00146484375, 2.5e-9, -1e-10, -0.0, 1e20, float("nan"), float("inf"), 0.1]
    rows = spark.createDataFrame([(values,), ([],), ([None, 0.5, None],), (None,)], "v array<double>")
    got = [r.t for r in rows.select(vector_literal(F.col("v")).alias("t")).collect()]
    assert got == ["[" + ",".join(f"{x:.8f}" for x in values) + "]", "[]", "[0.50000000]", None]


def test_numbers_are_rounded_as_in_sql(spark):
    """The scaled number is rounded, halves away from 0: 1.0108125 times a million is below the half."""
    cases = {1.0108125: 1.010812, -1.0108125: -1.010812, 1.0000005: 1.000001, -0.4500005: -0.450001, 0.4236245: 0.423625, 1e305: 1e305, 0.0: 0.0}
    rows = spark.createDataFrame([(k,) for k in cases], "x double").select("x", rounded(F.col("x"), 6).alias("r")).collect()
    assert {r.x: r.r for r in rows} == cases


ODD_TEXTS = ["two  words ", None, "", " \n ", "\x0btab\x0b", "\x85next", "a\x0bb\tc", " edge　", " line", "x \x1c", "again and again", "| |"]


def test_rebuilt_texts_of_odd_rows_equal_sql(spark, tmp_path):
    """Null and blank texts have a row, ends stay as SQL has them, and rows with one id are not thrown together."""
    rows = [(i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["reconstruct_abstract"](spark, f"file://{tmp_path}").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(db.execute(ORACLES["reconstruct_abstract"]).fetchall(), key=str)
    assert len(got) == len(ODD_TEXTS)
