import random
import re
import time

from pyspark.sql import functions as F

from citeloom.llm.decontamination import contaminated, decontaminate, item_shingles, shingle_filter, short_items, signatures


def brute(docs, items, least=5):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in items:
        w = words(t)
        k = min(5, len(w))
        if len(w) < least:
            continue
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, s in docs:
            v = words(s)
            n = len(want & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)})
            if n >= 0.8 * len(want) - 1e-9:
                out[d, i] = (n, len(want))
    return out


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_whole_table(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in contaminated(docs, items).collect()}
    assert want and got == want
    kept = {r.doc_id for r in decontaminate(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_partial_short_and_odd(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(44))  # 40 shingles
    cut = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = [(1, "x y " + cut(36) + " z"), (2, cut(35)), (3, None), (4, ""), (5, ("pad " * 50_000) + item.upper().replace(" ", ",  ")), (6, "Only three-words here"), (6, "Only three-words here"), (None, item)]
    items = [(10, item), (11, "only three words"), (12, None), (13, "..."), (14, "pad"), (10, item)]
    frame = make_docs(docs).withColumn("item_id", F.lit("clash")).withColumn("shingles", F.lit(0))
    found = lambda **o: {(r.doc_id, r.item_id): r.n_shared for r in contaminated(frame, items_frame(spark, items), **o).collect()}
    assert found() == {(1, 10): 32, (5, 10): 40}
    assert found(least_words=1) == {(1, 10): 32, (5, 10): 40, (5, 14): 1, (6, 11): 1}
    assert found(least_words=3) == {(1, 10): 32, (5, 10): 40, (6, 11): 1}
    assert {(r.item_id, r.n_words) for r in short_items(items_frame(spark, items)).collect()} == {(11, 3), (12, 0), (13, 0), (14, 1)}
    assert sorted(str(r.doc_id) for r in decontaminate(frame, items_frame(spark, items)).collect()) == ["2", "3", "4", "6", "6", "None"]
    assert sorted(str(r.doc_id) for r in decontaminate(frame, items_frame(spark, items), least_words=1).collect()) == ["2", "3", "4", "None"]
    assert decontaminate(frame, items_frame(spark, items)).columns == frame.columns
    assert contaminated(frame, items_frame(spark, [])).collect() == [] and contaminated(make_docs([]), items_frame(spark, items)).collect() == []


def test_random_pairs_of_every_size_class(spark, make_docs):
    """Shares of items around the threshold, in documents of all sizes; ids with several texts."""
    rnd = random.Random(8)
    items = [(i % 37, " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.choice((5, 6, 9, 20, 63, 64, 65, 130))))) for i in range(40)]
    docs = []
    for i in range(150):
        w = rnd.choice(items)[1].split()
        at, n = rnd.randrange(3), round(len(w) * rnd.choice((0.5, 0.8, 0.85, 0.9, 1)))
        docs.append((i % 140, " ".join([f"v{rnd.randrange(9)}" for _ in range(rnd.randrange(6))] + w[at : at + n] + [f"v{rnd.randrange(9)}"] * rnd.randrange(200))))
    want = {}
    for d in docs:
        for i in items:
            for k, (n, size) in brute([d], [i]).items():
                want[k] = max(want.get(k, (0, 0, 0)), (n / size, n, size))
    got = {(r.doc_id, r.item_id): (r.containment, r.n_shared, r.n_item) for r in contaminated(make_docs(docs), items_frame(spark, items)).collect()}
    assert len(want) > 40 and got == want


def test_small_documents_are_not_probed_in_large_classes(spark):
    """A class asks for so many shingles that no smaller document could hold one of its items."""
    items = items_frame(spark, [(n, " ".join(f"w{i}" for i in range(n + 4))) for n in (1, 2, 3, 7, 8, 15, 16, 100, 127, 128)])
    rows = signatures(item_shingles(items)).groupBy("item_id").agg(F.max("least").alias("least"), F.count("*").alias("n")).collect()
    for r in rows:
        lower = 1 << (r.item_id.bit_length() - 1)
        assert r.least == -(-lower * 4 // 5) and r.least <= -(-r.item_id * 4 // 5)
        assert r.n == min(r.item_id, (2 * lower - 1) // 5 + 1)


def test_filter_loses_nothing(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    passes = shingle_filter(hashes)
    assert hashes.where(passes(F.col("h"))).count() == 5000
    assert spark.range(10_000, 30_000).where(passes(F.xxhash64("id"))).count() < 1000


def test_long_document_and_long_item(spark, make_docs):
    """200,000 words against an item of 2,000 shingles: a time in proportion to both."""
    item = " ".join(f"w{i}" for i in range(2004))
    text = ("pad filler words " * 66_000) + item
    began = time.time()
    got = contaminated(make_docs([(1, text)]), items_frame(spark, [(1, item)])).collect()
    assert [(r.n_shared, r.n_item) for r in got] == [(2000, 2000)] and time.time() - began < 30
