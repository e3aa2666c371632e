import random

from citeloom.operators.levels import work_levels


def brute(works, edges):
    need = {w: {b for a, b in edges if a == w and b in works} for w in works}
    out, level = {}, 0
    while free := [w for w in need if w not in out and all(p in out for p in need[w])]:
        out.update(dict.fromkeys(free, level))
        level += 1
    return sorted((w, out.get(w), w not in out) for w in works)


def run(spark, works, edges):
    w = spark.createDataFrame([(x,) for x in works], "work_id string")
    e = spark.createDataFrame(edges, "citing_work_id string, cited_work_id string")
    return sorted(map(tuple, work_levels(w, e).collect()))


def test_random_graphs(spark):
    for seed, n, m in ((1, 30, 25), (2, 40, 60), (3, 12, 0)):
        rng = random.Random(seed)
        works = [f"W{i}" for i in range(n)]
        edges = [(rng.choice(works), rng.choice([*works, "outside"])) for _ in range(m)] * 2
        assert run(spark, works, edges) == brute(works, edges)


def test_chains_cycles_and_what_depends_on_them(spark):
    edges = [(f"c{i + 1}", f"c{i}") for i in range(6)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("free", "c3"), (None, "c0"), ("c0", None)]
    works = [f"c{i}" for i in range(7)] + ["x", "y", "z", "s", "free"]
    want = brute(works, edges)
    assert run(spark, [*works, None, "x"], edges) == want
    assert ("free", 4, False) in want and ("z", None, True) in want and ("s", None, True) in want


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, ["a"], []) == [("a", 0, False)]


def test_a_graph_that_no_row_holds(spark):
    """A million works, in layers of random edges: the levels are those of the layers."""
    n = 1_000_000
    works = spark.range(n).selectExpr("concat('W', id) AS work_id")
    edges = spark.range(n).where("id >= 250000").selectExpr("concat('W', id) AS citing_work_id", "concat('W', id - 250000) AS cited_work_id")
    got = work_levels(works, edges.unionByName(edges.limit(10))).groupBy("level", "in_citation_cycle").count().orderBy("level").collect()
    assert [tuple(r) for r in got] == [(i, False, 250_000) for i in range(4)]
