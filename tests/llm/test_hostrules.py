import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.llm.hostrules import host_rules, host_verdicts, measure

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    words = "".join(" " if c in SPACE else c for c in t).split(" ")
    words = [w for w in words if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts(docs):
    rnd = random.Random(4)
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", " \n\x0b", "a b c a b c", "a a a a", "é x #|\n é\n é", "x\n\nx\nx ", "\x1c y \x85"]
    texts += ["".join(rnd.choice("ab \n\t#é") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert measure(None if t is None else t.encode()) == brute(t), repr(t)


def test_whole_table(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = host_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed)  # no host here is bad as a whole


def test_shrunk_rates(spark):
    rows = [("good", False)] * 95 + [("good", True)] * 5 + [("bad", True)] * 80 + [("bad", False)] * 5 + [("tiny", True)] + [("fine", False)] * 50 + [(None, True)] * 9
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got.keys() == {"good", "bad", "tiny", "fine"}
    mean = 86 / 236
    assert got["bad"].host_failed and not got["good"].host_failed
    assert mean < got["tiny"].rate < 1 and got["tiny"].rate - mean < got["bad"].rate - mean + 0.2
    assert got["good"].rate == pytest.approx(0.05, abs=0.03)


def test_hosts_alike_shrink_to_the_mean(spark):
    rows = [(f"h{i}", k < 3) for i in range(20) for k in range(10)]
    got = host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()
    assert {round(r.rate, 9) for r in got} == {0.3} and not any(r.host_failed for r in got)


def test_edges(make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    bad = [(100 + i, "x " * 60, "en", "junk") for i in range(30)]
    rows = [(1, None), (2, ""), (3, long, None, None), (3, long, None, None), (4, long, "en", "junk"), (5, "y " * 300_000), (None, long, "en", None)]
    frame = make_docs(rows + bad).withColumn("host", F.lit("clash")).withColumn("kept", F.lit(1))
    got = host_rules(frame).collect()
    assert len(got) == len(rows) + len(bad)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[3] and kept[None] and not any(kept[i] for i in (1, 2, 4, 5))
    assert host_rules(make_docs([])).collect() == []
