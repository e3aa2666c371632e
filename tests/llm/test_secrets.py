import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from citeloom.llm.secrets import _CHARS, FALSE_RATE, LEAST, Model, best_mean, joined, labelled_samples, op7_secret_scan, scan, train

NOTHING = Model([-99.0] * 4489, 0.0)

ASSIGN = re.compile(r"""(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_whole_table(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op7_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("markov")] == [x for x in want.split(",") if x]


def test_base_on_odd_texts(make_docs):
    key, h = "AKIA" + "Q7" * 9, "0123456789abcdef" * 2
    texts = [None, "", "password=token:abcdefgh", "PassWD : 'ab' token='abcdef' secret= x1_/+.-=", "\U0001f600é api_KEY=\"abcdef\" api key=abcdef apikey:abcdef", f"{key} AKIAabc AKIA{h}", f"x{h}y {h}{h}", "ſecret=abcdef toKen=abcdef".replace("K", "K"), "token=token=abcdef", "token = secret = a", "\n".join(["token=abcdef"] * 5000), "x" * 300_000 + h, "é" * 7 + h + "token=" + h]
    frame = make_docs([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]).withColumn("spans", F.lit(0)).withColumn("tokens", F.lit("x"))
    got = scan(frame, NOTHING).select("doc_id", joined(F.col("base")).alias("b"), joined(F.col("spans")).alias("s")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.b == r.s == brute(texts[3 if r.doc_id is None else r.doc_id]), texts[r.doc_id or 3][:80]
    assert scan(make_docs([])).collect() == []


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(rnd, alphabet=LETTERS + "0123456789", n=32):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def training(spark, sf, make_docs):
    """Documents with labelled secrets of their own, so that the models know more than those of the table."""
    rnd = random.Random(3)
    rows = [(r.doc_id, f"{r.text} on 2024-01-{r.doc_id % 28 + 1:02d}, call 555-{r.doc_id % 9000 + 1000}; token={key(rnd)}") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return make_docs(rows)


@pytest.fixture(scope="module")
def model(training):
    return train(training)


def brute_added(text, model):
    """Spans by plain Python: every run, every stretch of LEAST characters, every base span."""
    base = [tuple(map(int, x.split(":")[1:])) for x in brute(text).split(",") if x]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        gains = [model.ratios[_CHARS.index(a) * len(_CHARS) + _CHARS.index(b)] for a, b in zip(m[0], m[0][1:])]
        best = max(sum(gains[i : i + LEAST - 1]) for i in range(len(gains) - LEAST + 2)) / (LEAST - 1)
        if best > model.threshold and not any(s < m.end() and m.start() < e for s, e in base):
            out.append(f"markov:{m.start()}:{m.end()}")
    return out


def test_added_spans_against_brute_force(make_docs, training, model):
    rnd = random.Random(9)
    texts = [r.text for r in training.collect()][:60]
    planted = []
    for i, t in enumerate(texts):
        cut = rnd.randrange(len(t) + 1)
        k = [key(rnd), key(rnd, LETTERS, 40), f"/theation/thereandthe/andthering/{key(rnd)}", f"session_identifier_value={key(rnd)}", f"token={key(rnd)} x {key(rnd)}", ""][i % 6]
        planted.append(f"é {t[:cut]} {k} {t[cut:]}")
    rows = scan(make_docs(list(enumerate(planted))), model).select("doc_id", joined(F.col("spans")).alias("s")).collect()
    found = 0
    for r in rows:
        got = [x for x in r.s.split(",") if x.startswith("markov")]
        assert got == brute_added(planted[r.doc_id], model)
        found += bool(got)
    assert found >= 50  # five of six texts have a key that only the models find


def test_threshold_is_calibrated(training, model):
    """On held-out ordinary strings the stated rate is kept; held-out labelled secrets are found."""
    values, several = labelled_samples(training)
    rate = several.select((best_mean(F.col("value"), model.ratios) > model.threshold).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert rate <= 2 * FALSE_RATE
    held = values.where("random AND length(value) >= 20").where(F.pmod(F.xxhash64("value"), F.lit(5)) == 0)
    assert held.select((best_mean(F.col("value"), model.ratios) > model.threshold).cast("int").alias("x")).agg(F.avg("x")).first()[0] > 0.9


def test_ordinary_runs_stay(make_docs, model):
    path = "/theation/thereandthe/andthering/theandthere/reandtheation/thingandthere/"
    plain = [path, "theationthandere_and_reing_the_2", "andtheinthestion/thereanding/2024-01-15", "verlichkeitungenschaftlichung", "-" * 40]
    got = scan(make_docs([(i, f"see {t} there") for i, t in enumerate(plain)]), model).where("size(spans) > 0").collect()
    assert got == []


def test_overlaps_and_time(make_docs, model):
    """Base spans next to, inside and over runs; many matches in one text take a time in proportion."""
    rnd = random.Random(4)
    h = "0123456789abcdef" * 2
    odd = [f"{key(rnd)}+{h}", f"{h} {key(rnd)}", f"token={key(rnd)}={h}", f"{key(rnd)}.token:{key(rnd)} {key(rnd)}", f"{key(rnd)}Zz{h}Zz{key(rnd)} {key(rnd)}"]
    got = scan(make_docs(list(enumerate(odd))), model).select("doc_id", joined(F.col("spans")).alias("s")).collect()
    assert all([x for x in r.s.split(",") if x.startswith("markov")] == brute_added(odd[r.doc_id], model) for r in got)
    many = f"{h} theationthere/andthering " * 20_000
    began = time.time()
    r = scan(make_docs([(1, many)]), model).first()
    assert len(r.base) == 20_000 and r.base[-1].end == len(many) - 26 and time.time() - began < 60


def test_nothing_to_learn_from(make_docs):
    assert train(make_docs([])).ratios == NOTHING.ratios
    assert scan(make_docs([(1, "only words here"), (2, key(random.Random(1)))])).where("size(spans) > 0").collect() == []
