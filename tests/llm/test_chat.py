import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from citeloom.llm.chat import escape, format_turn, op6_chat_prefix_trees, prefix_trees, read_back, read_turn, unescape

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escapes_are_reversible():
    rnd = random.Random(2)
    parts = ["<|", "|>", "<", "|", "\\", "</s>", "<s>", "[INST]", "[/INST]", "a", "\n", "<|says|>", "<|done|>", "<|turn|>", "é"]
    for _ in range(2000):
        role, text = ("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(2))
        body, lo, hi = format_turn(role, text)
        assert unescape(escape(text)) == text and read_turn(body) == (role, text) and unescape(body[lo:hi]) == text
        assert not any(c in escape(text) for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
    with pytest.raises(ValueError):
        read_turn("x")


def brute_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), sum(len(format_turn(r, t)[0]) for r, t in turns)


def check(spark, rows):
    convs = defaultdict(list)
    for c, n, r, t in sorted(rows, key=lambda x: (x[1], x[2] or "", x[3] or "")):
        convs[c].append((r or "", t or ""))
    packed, index = prefix_trees(spark.createDataFrame(rows, SCHEMA).repartition(5))
    nodes = sorted(packed.collect(), key=lambda r: r.start)
    by_start = {r.start: r for r in nodes}
    assert len(by_start) == len({tuple(v[: i + 1]) for v in convs.values() for i in range(len(v))}) == len(nodes)
    at = 0
    for r in nodes:  # one gapless sequence
        assert r.start == at
        at += len(r.body)
    paths = defaultdict(dict)
    for r in index.collect():
        paths[r.conv_id][r.i] = r.start
    seen = {}
    for c, turns in convs.items():
        path = [by_start[paths[c][i]] for i in range(len(turns))]
        assert [read_turn(n.body) for n in path] == turns
        ancestors = []
        for n, (role, text) in zip(path, turns):
            assert n.position == sum(e - s for s, e in ancestors) and [tuple(a) for a in n.attends] == joined(ancestors)
            assert unescape(n.body[n.learn_from : n.learn_to]) == (text if role == "assistant" else "")
            seen[n.start] = [s for s, _ in ancestors]
            ancestors.append((n.start, n.start + len(n.body)))
    order = list(seen)
    for s in order:  # depth first: everything between an ancestor and a node is below that ancestor
        for a in seen[s]:
            assert all(a in seen[x] for x in order if a < x < s)
    got = {r.conv_id: tuple(r)[1:] for r in read_back(packed, index).collect()}
    assert got == {c: brute_digest(v) for c, v in convs.items()}


def joined(spans):
    out = []
    for s, e in spans:
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def test_random_trees(spark):
    rnd = random.Random(8)
    rows = []
    for c in range(60):
        for i in range(rnd.randint(1, 7)):
            rows.append((c, i, ("user", "assistant")[i % 2], rnd.choice("xyz") if i < 5 else "same"))
    rows += [(100, i, "user", "t" * 50) for i in range(300)]
    check(spark, rows)


def test_edges(spark):
    rows = [(1, 0, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "assistant", "</s>"), (4, 5, "assistant", "x" * 400_000)]
    rows = [r for r in rows if r[1] is not None]
    check(spark, rows)
    frame = spark.createDataFrame([(None, 1, "user", "q"), (None, None, "assistant", "z")], SCHEMA).withColumn("body", F.lit(1)).withColumn("node", F.lit("x"))
    got = read_back(*prefix_trees(frame)).collect()
    assert [tuple(r) for r in got] == [(None, *brute_digest([("assistant", "z"), ("user", "q")]))]
    assert read_back(*prefix_trees(frame.limit(0))).collect() == []


def test_whole_table(spark, sf):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role, r.text))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: tuple(r)[1:] for r in op6_chat_prefix_trees(spark, sf).collect()}
    assert got == {c: brute_digest(v) for c, v in convs.items()}
