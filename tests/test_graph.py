import random

import pytest
from pyspark.errors import PySparkException

from citeloom.operators import graph, snowball

MEMBERS = "collection_id long, work_id string, foundational_score double"
EDGES = "citing_work_id string, cited_work_id string"


def paths(spark, cases):
    """cases: [(scores, edges)] -> [[(work, prerequisites, unlocks, flag)]]."""
    members = [(i, w, s) for i, (scores, _) in enumerate(cases) for w, s in scores.items()]
    edges = [(i, a, b) for i, (_, e) in enumerate(cases) for a, b in e]
    rows = graph.reading_paths(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(edges, "collection_id long, " + EDGES), strict=True).collect()
    out = [[] for _ in cases]
    for r in sorted(rows, key=lambda r: (r.collection_id, r.rank)):
        assert r.rank == len(out[r.collection_id])
        out[r.collection_id].append((r.work_id, r.prerequisites, r.unlocks, r.in_citation_cycle))
    return out


def edges_of(text):
    return [tuple(x.split(">")) for x in text.split()]


def test_stated_cases(spark):
    cases = [
        ({"A": 10.0, "B": 5.0, "C": 1.0, "D": 0.5}, edges_of("B>A C>A D>B D>C")),
        ({"X": 2.0, "Y": 9.0}, edges_of("X>Y Y>X")),
        ({"P": 10.0, "Q": 5.0, "X": 2.0, "Y": 1.0}, edges_of("Q>P X>Y Y>X")),
        ({"M": 3.0, "N": 7.0, "O": 1.0}, []),
        ({"Z": 1.0, "A": 1.0, "M": 1.0}, []),
        ({str(i): -float(i) for i in range(5)}, [(str(i), str(i - 1)) for i in range(1, 5)]),
        ({"a": 1.0, "b": 9.0, "c": 0.5}, edges_of("b>a")),
        ({"X": 2.0, "Y": 1.0, "Z": 99.0, "S": 5.0, "T": None}, edges_of("X>Y Y>X Z>X S>S X>Y")),
    ]
    got = paths(spark, cases)
    order = ["".join(w for w, *_ in p) for p in got]
    assert order == ["ABCD", "YX", "PQXY", "NMO", "AMZ", "01234", "abc", "TZSXY"]
    flags = ["".join(w for w, _, _, f in p if f) for p in got]
    assert flags == ["", "YX", "XY", "", "", "", "", "ZSXY"]
    a, *_, d = got[0]
    assert a[1:3] == ([], ["B", "C"]) and d[1:3] == (["B", "C"], [])
    assert all(p[1:3] == ([], []) for p in got[3])


def test_edges_that_leave(spark):
    with pytest.raises(PySparkException):
        paths(spark, [({"P1": 1.0}, [("P1", "OUTSIDE")])])
    members = spark.createDataFrame([(1, "P1", 1.0)], MEMBERS)
    assert [r.work_id for r in graph.reading_paths(members, spark.createDataFrame([("P1", "OUTSIDE")], EDGES)).collect()] == ["P1"]
    assert graph.reading_paths(members.limit(0), spark.createDataFrame([], EDGES)).collect() == []


def brute(scores, edges):
    need = {w: {b for a, b in edges if a == w} for w in scores}
    out = []
    while True:
        free = [w for w in scores if w not in out and need[w] <= set(out)]
        if not free:
            break
        out.append(min(free, key=lambda w: (-scores[w], w)))
    return out + sorted((w for w in scores if w not in out), key=lambda w: (-scores[w], w)), len(out)


def test_random_graphs(spark):
    rnd = random.Random(6)
    cases = []
    for _ in range(60):
        names = [f"w{i}" for i in range(rnd.randint(1, 9))]
        scores = {n: float(rnd.randint(0, 4)) for n in names}
        cases.append((scores, [(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randint(0, 10))]))
    for (scores, edges), path in zip(cases, paths(spark, cases)):
        order, n = brute(scores, edges)
        assert [p[0] for p in path] == order and [p[3] for p in path] == [False] * n + [True] * (len(order) - n)
        placed = set()
        for w, before, after, blocked in path:
            assert before == sorted({b for a, b in edges if a == w}) and after == sorted({a for a, b in edges if b == w})
            assert blocked or set(before) <= placed
            placed.add(w)


def test_links(spark):
    papers = spark.createDataFrame([("a", "A"), ("b", "it's B"), ("c", "C")], "work_id string, title string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c")], EDGES)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c"), ("a", "zz")], "a string, b string")
    got = {(r.a, r.b): (r.a_cites_b, r.b_cites_a) for r in graph.compare_papers(pairs, papers, edges).collect()}
    assert got == {("a", "b"): (True, False), ("b", "a"): (False, True), ("a", "c"): (False, False), ("c", "c"): (True, True)}
    said = {(r.citing, r.cited): r.explanation for r in graph.explain_links(pairs, papers, edges).collect()}
    assert said["a", "b"] == "'A' cites \"it's B\" -- read the latter first." and said["a", "c"].startswith("No direct")


def test_snowball(spark):
    universe = spark.createDataFrame([("t", "s1", 9), ("t", "s2", 8), ("t", "x", 1), ("u", "y", 5), ("u", "s2", 1)], "topic string, work_id string, cited_by_count long")
    edges = spark.createDataFrame([("s1", "x"), ("s1", "s2"), ("s1", "gone"), ("y", "s1"), ("x", "s1"), ("y", "s2")], EDGES)
    got = {(r.topic, r.work_id): r.hop for r in snowball.snowball(universe, edges, 2).collect()}
    assert got == {("t", "s1"): "seed", ("t", "s2"): "seed", ("t", "x"): "cited", ("t", "y"): "citing", ("u", "y"): "seed", ("u", "s2"): "seed", ("u", "s1"): "cited"}
    assert {r.topic: r.works for r in snowball.harvest_summary(snowball.snowball(universe, edges, 2)).collect()} == {"t": 4, "u": 3, None: 7}
