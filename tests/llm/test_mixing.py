import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from citeloom.llm import mixing
from citeloom.llm.mixing import ALPHA, calibrate, learn_topics, mix, rake, sample_mix, shares, terms

CELLS = "source string, lang string, topic string, tokens long"


def reach(target, parts):
    """The factor at which sum(min(bound, factor * weight)) is the target, by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most, mid * free) for free, most in parts) < target else (low, mid)
    return high


def brute_rake(cells, targets=None, rounds=400, keep=None):
    total = sum(c[3] for c in cells)
    most = {c[:3]: c[3] / (keep * total) if keep else float("inf") for c in cells}
    power = {c[:3]: c[3] ** ALPHA for c in cells}
    scale = reach(1.0, [(power[k], most[k]) for k in power])
    aimed = {k: min(most[k], scale * power[k]) for k in power}
    free = {c[:3]: c[3] / total for c in cells}
    for _ in range(rounds):
        for k, d in enumerate(("source", "lang", "topic")):
            own = defaultdict(float)
            for key, x in aimed.items():
                own[key[k]] += x
            aim = {v: (targets[d].get(v, 0.0) if targets and d in targets else own[v]) for v in own}
            norm = sum(aim.values())
            factor = {v: reach(aim[v] / norm, [(x, most[key]) for key, x in free.items() if key[k] == v]) for v in own} if aim else {}
            free = {key: x * factor[key[k]] for key, x in free.items()}
    return {key: min(most[key], x) for key, x in free.items()}


def test_rake_meets_marginals(spark):
    cells = [(s, x, t, 100 * (i + 1) ** 2 + 7 * j + 900 * k) for i, s in enumerate("abc") for j, x in enumerate(("en", "de")) for k, t in enumerate(("p", "q"))]
    for targets in (None, {"source": {"a": 0.5, "b": 0.3, "c": 0.2}}, {"source": {"a": 5, "b": 3}, "lang": {"en": 1, "de": 2}}):
        got = {(r.source, r.lang, r.topic): r.weight for r in rake(spark.createDataFrame(cells, CELLS), targets).collect()}
        want = brute_rake(cells, targets)
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-5)


def test_bounded_weights_meet_marginals(spark, monkeypatch):
    """Small cells that the targets ask more of than they hold: bounds hold, marginals too, weights as by bisection."""
    cells = [(s, x, t, 100 * (i + 1) ** 3 + 9 * j + 50 * k * (i + 1)) for i, s in enumerate("abcd") for j, x in enumerate(("en", "de", "fr")) for k, t in enumerate(("p", "q"))]
    total, keep = sum(c[3] for c in cells), 0.6
    frame = spark.createDataFrame(cells, CELLS)
    for targets in (None, {"lang": {"en": 0.5, "de": 0.3, "fr": 0.2}}):
        raked = rake(frame, targets, keep=keep)
        got = {(r.source, r.lang, r.topic): (r.weight, r.tokens) for r in raked.collect()}
        want = brute_rake(cells, targets, 60, keep)
        assert all(got[k][0] == pytest.approx(v, abs=1e-5) for k, v in want.items())
        assert all(w <= n / (keep * total) * (1 + 1e-9) for w, n in got.values())
        assert any(w == pytest.approx(n / (keep * total), rel=1e-9) for w, n in got.values())
        reported = shares(calibrate(raked, keep)).collect()
        assert len(reported) == 9 and all(r.expected == pytest.approx(r.target, abs=2e-6) for r in reported)
        assert targets is None or {r.category: round(r.expected, 5) for r in reported if r.dimension == "lang"} == targets["lang"]
    monkeypatch.setattr(mixing, "MAX_STEPS", 3)
    with pytest.raises(ValueError, match="of a sample of 0.6 of the tokens"):
        rake(frame, {"source": {"a": 0.9, "d": 0.1}}, keep=keep)


def test_one_task_or_many(spark, monkeypatch):
    cells = [(f"s{i % 7}", f"l{i % 3}", f"t{i % 2}", 10 + i * i) for i in range(42)]
    frame = spark.createDataFrame(cells, CELLS)
    for keep in (None, 0.6):
        monkeypatch.setattr(mixing, "ONE_TASK", 100)
        one = {r[:3]: r.weight for r in rake(frame, keep=keep).collect()}
        monkeypatch.setattr(mixing, "ONE_TASK", 3)
        assert {r[:3]: pytest.approx(r.weight, abs=1e-12) for r in rake(frame, keep=keep).collect()} == one


def test_targets_that_cannot_be_met_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 3)
    cells = spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "q", 90), ("b", "y", "q", 10)], CELLS)
    with pytest.raises(ValueError, match="cannot be met together: one is off by 0.7"):
        rake(cells, {"source": {"a": 0.1, "b": 0.9}, "lang": {"x": 0.9, "y": 0.1}})
    with pytest.raises(ValueError, match="no share for any lang"):
        rake(cells, {"lang": {"z": 1.0}})


def test_topics_follow_the_words(spark, make_docs):
    """Documents of two vocabularies, in any order and case, come into topics of their own; each is in its likeliest topic."""
    rnd = random.Random(2)
    vocabularies = [[f"{v}{i}" for i in range(40)] for v in ("sea", "law")]
    docs = make_docs([(i, " ".join(rnd.choice((str.upper, str.lower))(rnd.choice(vocabularies[i % 2])) for _ in range(30))) for i in range(200)] + [(500, None), (501, " ")])
    rows = docs.select("doc_id", terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    model = learn_topics(rows, 4)
    got = {r.doc_id: (r.topic, r.terms) for r in rows.select("doc_id", "terms", model.of(F.col("terms")).alias("topic")).collect()}
    sides = [{got[i][0] for i in range(200) if i % 2 == k} for k in (0, 1)]
    assert sides[0] and sides[1] and not sides[0] & sides[1]
    for topic, found in got.values():
        score = [p + sum(row[t] for t in found) for p, row in zip(model.topics, model.terms)]
        assert not found and topic == "t0" or score[int(topic[1:])] == pytest.approx(max(score))


def test_calibration_hits_the_budget(spark):
    cells = [("a", "x", "t", 10, 0.5), ("b", "x", "t", 1000, 0.3), ("c", "x", "t", 500, 0.2), ("d", "x", "t", 50, 0.0)]
    rows = calibrate(spark.createDataFrame(cells, CELLS + ", weight double"), 0.6).collect()
    prob = {r.source: r.prob for r in rows}
    assert prob["a"] == 1 and prob["d"] == 0 and 0 < prob["b"] < 1
    assert sum(r.prob * r.tokens for r in rows) == pytest.approx(0.6 * 1560)
    assert prob["b"] / prob["c"] == pytest.approx((0.3 / 1000) / (0.2 / 500))


def test_whole_table(docs):
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    assert sum(r.weight for r in rows) == pytest.approx(1, abs=1e-6)
    sums, weights = defaultdict(int), defaultdict(float)
    for r in rows:
        sums[r.source, r.lang, r.topic] += r.n_tokens
        weights[r.source, r.lang, r.topic] += r.weight
    total = sum(sums.values())
    want = brute_rake([(*k, n) for k, n in sums.items() if n], rounds=25, keep=0.7)
    for k, d in enumerate(("source", "lang", "topic")):
        for v in {key[k] for key in sums}:
            expected = sum(r.prob * r.n_tokens for r in rows if r[d] == v) / (0.7 * total)
            assert expected == pytest.approx(sum(x for key, x in want.items() if key[k] == v), abs=1e-4), (d, v)
    assert all(weights[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    assert len({r.topic for r in rows}) > 1
    expected = sum(r.prob * r.n_tokens for r in rows) / sum(r.n_tokens for r in rows)
    assert expected == pytest.approx(0.7, abs=1e-6)
    assert {r.doc_id for r in sample_mix(docs).collect()} == {r.doc_id for r in rows if r.kept}


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "a b c", None, None), (3, "a b c", None, None), (4, "w " * 300_000), (None, "x")]
    frame = make_docs(rows).withColumn("weight", F.lit("clash")).withColumn("_t_source", F.lit(1))
    got = mix(frame, keep=1.0).collect()
    assert len(got) == len(rows)
    assert all((r.prob, r.weight, r.kept) == (0, 0, False) for r in got if r.doc_id in (1, 2))
    assert all(r.kept for r in got if r.doc_id not in (1, 2))
    assert sorted(str(r.doc_id) for r in sample_mix(frame, keep=1.0).collect()) == ["3", "3", "4", "None"]
    assert sample_mix(frame).columns == frame.columns
    assert mix(make_docs([])).collect() == []
