import random
import re
from collections import Counter

import duckdb
import pytest

from citeloom.llm import divergence as D
from citeloom.llm.divergence import OP11_SQL, Block, merged, op11_source_divergence, pieces_of, source_divergence, term_frequencies

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=3, top=50):
    """rows: (text, lang, source); the result in plain Python."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = {}, {}
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: [t for t, n in d.items() if n >= min_docs] for lang, d in docs.items()}
    share = lambda n, total: 1 + 10**9 * (n + 5) // total
    out = []
    for (lang, source), c in counts.items():
        ks, sources = kept[lang], [s for x, s in counts if x == lang]
        total = lambda s, lang=lang, ks=ks: sum(counts[lang, s][t] for t in ks) + 5 * len(ks)
        p = {t: share(c[t], total(source)) for t in ks}
        pairs = [(sum(abs(p[t] - share(counts[lang, s][t], total(s))) for t in ks), s) for s in sources if s != source]
        whole = sum(sum(counts[lang, s][t] for t in ks) for s in sources) + 5 * len(ks)
        terms = [(p[t] - share(sum(counts[lang, s][t] for s in sources), whole), t) for t in ks if c[t]]
        for part, found, most in (("pair", pairs, None), ("term", [x for x in terms if x[0] > 0], top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df, **kw):
    return sorted(tuple(r) for r in source_divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    words = ["Alpha", "beta", "été", "ΔΕΛΤΑ", "naïve", "zoo", "x", "日本語", "nb sp", "émile", "Beta"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(300):
        own = words[i % 7 :] if i % 2 else words
        rows.append((" ".join(rng.choice(own) + rng.choice(["", ",", "'", "7", "\t"]) for _ in range(rng.randint(0, 40))), ["en", "fr", None, ""][i % 4], ["s1", "s2", None, "", "S3"][rng.randrange(5)]))
    rows += [("alpha beta " * 400, "en", "hot")] * 40 + [(None, "xx", "only"), ("", "xx", "none"), ("7 8 9", "yy", "s"), ("a\x00b", "l\x00a\x01", "s\x01\x02"), ("a\x00b", "l\x00a\x01", "s\x00")] * 3
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_equals_brute_force(spark, mixed):
    assert rows_of(frame(spark, mixed), min_docs=3) == brute(mixed)


def test_many_runs_in_several_passes(spark, mixed, monkeypatch):
    """Blocks that fill at once, chunks of a few postings and a fan-in of two give the same."""
    df = frame(spark, mixed).repartition(7)
    assert rows_of(df, min_docs=3, block_postings=60, fan_in=2, shards=3) == brute(mixed)
    one = {r.term: sorted(zip(r.sources, r.counts, strict=True)) for r in term_frequencies(df, 3, 3, 60, 2).where("lang = 'en'").collect()}
    assert one["alpha"] == sorted(Counter(s or "" for t, lang, s in mixed if lang == "en" for x in TERM.findall(t) if x == "Alpha" or x == "alpha").items())


def test_empty_and_clashing(spark):
    df = frame(spark, []).selectExpr("*", "1 AS term", "2 AS value", "3 AS rank", "4 AS part", "5 AS item", "6 AS n")
    assert rows_of(df) == []
    one = frame(spark, [("a b", "en", "s"), ("a", "en", "t")]).selectExpr("*", "1 AS term", "2 AS value", "3 AS rank", "4 AS n")
    assert rows_of(one) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert rows_of(one, min_docs=1) == brute([("a b", "en", "s"), ("a", "en", "t")], 1)


def test_pieces_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(D, "_PIECE", 7)
    text = ("één twoö 33 " + "lang" * 3000 + " x").encode()
    assert b" ".join(b"".join(pieces_of(text)).split()) == b" ".join(text.translate(D._TERM_BYTES).split())
    assert all(p[-1:] == b" " for p in list(pieces_of(text))[:-1])
    block = Block()
    block.add(b"en", b"s", b"same same other same")  # in several pieces, and still one document
    postings = {k: (n, d) for _, (k, n, d) in merged(iter(block.run(1, 0)))}
    assert postings == {b"same\0en\0s": (3, 1), b"other\0en\0s": (1, 1)}


def test_merge_opens_one_chunk_of_a_run(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 5)
    batches = []
    for run in range(4):
        block = Block()
        for i in range(60):
            block.add(b"en", b"s", b"w" + bytes([97 + i % 26, 97 + i // 26]))
        batches += list(block.run(2, run))
    batches.sort(key=lambda b: (b["shard"][0].as_py(), b["first"][0].as_py()))
    opened, most = [], 0

    class Watched:
        def __init__(self, it):
            self.it = it
            opened.append(self)

        def __iter__(self):
            return self

        def __next__(self):
            try:
                return next(self.it)
            except StopIteration:
                opened.remove(self)
                raise

    real = D._chunks
    monkeypatch.setattr(D, "_chunks", lambda b: ((s, f, Watched(p)) for s, f, p in real(b)))
    seen = []
    for shard, posting in merged(iter(batches)):
        most = max(most, len(opened))
        seen.append((shard, posting[0]))
        assert posting[1:] == (4, 4)
    assert seen == sorted(seen) and len(seen) == 60
    assert most <= 5  # one chunk of each of four runs, and the one that is read ahead


def test_chunks_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(D, "CHUNK_BYTES", 100)
    block = Block()
    for i in range(20):
        block.add(b"en", b"s", bytes([97 + i]) * 70)
    sizes = [len(b["terms"][0].as_py().split()) for b in block.run(1, 0)]
    assert sum(sizes) == 20 and max(sizes) <= 2


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = op11_source_divergence(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    by = list(got.columns)
    want = con.execute(OP11_SQL).df()[by]
    assert len(got) and got.sort_values(by).values.tolist() == want.sort_values(by).values.tolist()
