import hashlib
import math

import duckdb
import numpy as np
import pytest

from citeloom.llm import vectorcodes as V
from citeloom.llm.vectorcodes import OP12_SQL, Codebooks, anchors, build_forest, op12_vector_codes, pack, scaled, unpack, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=V.ROUNDS):
    """(vec_id, code, error, label_error, digest) in plain Python integers, sorted."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vecs = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    if not kept:
        return []
    w = len(vecs[0]) // 8
    parts = [[v[p * w : (p + 1) * w] for v in vecs] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]
    sq = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (sq(x, book[k]), k))
    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            owner = [near(x, book) for x in part]
            for k in range(len(book)):
                mine = [x for x, o in zip(part, owner, strict=True) if o == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    codes = [[near(part[i], book) for part, book in zip(parts, books, strict=True)] for i in range(len(vecs))]
    errors = [sum(sq(parts[p][i], books[p][c]) for p, c in enumerate(code)) for i, code in enumerate(codes)]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), e, by_label[r[2]], digest) for r, code, e in zip(kept, codes, errors, strict=True)), key=repr)


def coded(df, **kw):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vector_codes(df, **kw).collect()), key=repr)


def test_equals_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.05 * rng.normal(size=16)], i % 3) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(200)]  # many copies
    rows += [(3, rows[9][1], None), (3, rows[9][1], None), (None, rows[11][1], 2), (5000, None, 1)]
    rows += [(5001, [float("nan")] * 16, 1), (5002, [float("inf")] + [0.0] * 15, 1), (5003, [None] + [0.0] * 15, 1), (5004, [300000.0, -7e8] + [0.5] * 14, 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows])
    assert coded(df) == want
    assert coded(df, block_bytes=64 * 100) == want


def test_ties_few_rows_and_empty(spark):
    square = [(i, [float(i % 2)] * 8, None) for i in range(40)]  # equal entries and equal distances
    assert coded(spark.createDataFrame(square, SCHEMA)) == brute(square)
    few = [(2, [1.0] * 8, 1), (1, [0.5] * 8, 1)]
    assert coded(spark.createDataFrame(few, SCHEMA)) == brute(few)
    assert coded(spark.createDataFrame([], SCHEMA)) == []
    assert coded(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []


def test_lengths_must_agree(spark):
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)]):
        with pytest.raises(Exception, match="length"):
            vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()


def test_clashing_columns_and_label_types(spark):
    df = spark.createDataFrame([(i, [i / 7] * 8, f"l{i % 2}", "x", "y", 1) for i in range(20)], "vec_id int, embedding array<double>, label string, code string, part string, _n int")
    got = vector_codes(df)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert coded(df) == brute([(i, [i / 7] * 8, i % 2) for i in range(20)])


def test_rare_labels_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(V, "FREQUENT", 3)
    rows = [(i, [i % 5 / 3] * 8, 0 if i < 60 else i) for i in range(100)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_balls_hold_their_points_and_cached_sums():
    x = scaled(np.random.default_rng(1).normal(size=(700, 16)).astype(np.float32))
    x[100:300] = x[100]
    forest = unpack(pack(build_forest(x), 2))
    assert sorted(forest["place"][:700].tolist()) == list(range(700))
    for node, total in zip(forest["node"], forest["sum"], strict=True):
        mine = forest["points"][node["start"] : node["end"]]
        assert (mine.sum(axis=0) == total).all()
        assert np.sqrt(((mine - total / len(mine)) ** 2).sum(axis=1)).max() <= node["radius"]
        if node["left"] >= 0:
            left, right = forest["node"][node["left"]], forest["node"][node["right"]]
            assert (left["start"], left["end"], right["end"]) == (node["start"], right["start"], node["end"])


def test_anchors_own_what_is_nearest():
    x = np.random.default_rng(2).normal(size=(300, 3))
    owned = anchors(x, 17)
    assert sorted(np.concatenate(owned).tolist()) == list(range(300))
    assert len(anchors(np.zeros((50, 3)), 8)) == 1


def test_clustered_points_are_owned_by_the_ball():
    """Where entries lie apart, cached sums stand for nearly all points, and dropping no candidate would show."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-40000, 40000, size=(16, 16))
    x = (centres[rng.integers(0, 16, 2000)] + rng.integers(-50, 50, size=(2000, 16))).astype(np.float64)
    books = Codebooks([[c[p * 2 : p * 2 + 2].tolist() for c in centres] for p in range(8)])
    forest = unpack(pack(build_forest(x), 2))
    owned = sum(len(where) for _, _, ball, where in books.walk(forest) if ball is not None)
    assert owned > 0.9 * 8 * 2000
    for part, entry, _, where in books.walk(forest):
        assert (books.nearest(forest["points"][where], part) == entry).all()


def test_query_equals_sql(spark, sf):
    got = op12_vector_codes(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = con.execute(OP12_SQL).df()[list(got.columns)]
    by = list(got.columns)
    assert got.sort_values(by).values.tolist() == want.sort_values(by).values.tolist()
