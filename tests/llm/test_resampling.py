import math
import struct
from collections import Counter
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm.resampling import BUCKETS, SMOOTHING, features, fit, importance_resample, log_weights

M = (1 << 64) - 1
K = 0x9E3779B97F4A7C15
SHIFT = 64 - BUCKETS.bit_length() + 1


def brute_features(text):
    words = (text or "").encode().lower().split()
    one = [(crc32(w) + 1) * K & M for w in words]
    two = [((a ^ a >> 31) + crc32(w)) * K & M for a, w in zip(one, words[1:])]
    return Counter(x >> SHIFT for x in one + two)


def test_model_and_weights_against_brute_force(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    raw, target, own = Counter(), Counter(), {}
    for r in docs.collect():
        own[r.doc_id] = brute_features(r.text)
        raw.update(own[r.doc_id])
        if r.doc_id in good:
            target.update(own[r.doc_id])
    ratios = fit(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))
    nr, nt = sum(raw.values()) + SMOOTHING * BUCKETS, sum(target.values()) + SMOOTHING * BUCKETS
    want = [math.log((target[b] + SMOOTHING) / nt) - math.log((raw[b] + SMOOTHING) / nr) for b in range(BUCKETS)]
    assert ratios == pytest.approx(want)
    for r in log_weights(docs, ratios).collect():
        assert r.n_features == sum(own[r.doc_id].values())
        assert r.log_weight == pytest.approx(sum(n * want[b] for b, n in own[r.doc_id].items()), abs=1e-6)


def test_selection(spark):
    sf = "/root/testdata/sf0.01"  # enough labels for shares
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = importance_resample(docs, labels).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    share = sum(q == 1 for q in quality.values()) / len(quality)
    assert sorted(r.rank for r in rows) == list(range(docs.count()))
    assert sum(r.kept for r in rows) == math.ceil(share * len(rows) - 1e-9)
    assert max(r.key for r in rows if not r.kept) <= min(r.key for r in rows if r.kept)
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1]
    poor = [r.kept for r in rows if quality.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.9 > 0.3 > sum(poor) / max(len(poor), 1)


def brute_gumbel(doc_id, seed=11):
    first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), first)
    return -math.log(-math.log(((h >> 12) + 0.5) / (1 << 52)))


def test_keys_and_order_against_brute_force(spark, sf, docs):
    rows = importance_resample(docs, spark.read.parquet(f"{sf}/labels.parquet"), 0.3).collect()
    want = {r.doc_id: r.log_weight + brute_gumbel(r.doc_id) for r in rows}
    assert all(r.key == pytest.approx(want[r.doc_id], abs=1e-9) for r in rows)
    order = sorted(want, key=lambda d: (-want[d], d))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.rank)] == order
    assert {r.doc_id for r in rows if r.kept} == set(order[: math.ceil(0.3 * len(order))])


def test_pieces(monkeypatch):
    text = b"A b c d e f g h"
    whole = Counter(x for f in features(text, dict_ids()) for x in f.tolist())
    monkeypatch.setattr("citeloom.llm.resampling._PIECE", 3)
    assert Counter(x for f in features(text, dict_ids()) for x in f.tolist()) == whole == brute_features(text.decode())


def dict_ids():
    from citeloom.llm.resampling import _Ids

    return _Ids()


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "good words here"), (2, "bad words"), (3, None), (4, ""), (4, ""), (None, "x"), (5, "w " * 200_000)]
    frame = make_docs(rows).withColumn("kept", F.lit("clash")).withColumn("quality", F.lit(0))
    got = importance_resample(frame, labels).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == math.ceil(0.5 * len(rows))
    assert [r.log_weight for r in got if r.doc_id in (3, 4)] == [0.0] * 3
    assert all(r.kept and r.log_weight == 0 for r in importance_resample(frame, labels.limit(0)).collect())
    assert importance_resample(make_docs([]), labels).collect() == []
