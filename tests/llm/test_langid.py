import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import langid
from citeloom.llm.langid import FALSE_REJECTION, ORDER, TRAIN_CHARS, fit, keep_accepted, letters, predict, rejection_limit, train, training_sample


@pytest.fixture(scope="module")
def model(docs):
    return train(docs)


def test_held_out_accuracy(docs, model):
    rows = predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def gram_counts(texts):
    codes, _ = letters(texts)
    grams = np.stack([codes[i : len(codes) - ORDER + 1 + i] for i in range(ORDER)], axis=1)
    grams = grams[grams[:, -1] != langid.BOS]
    return np.unique(grams, axis=0, return_counts=True)


def brute_kneser_ney(counts, every_char):
    """p(gram) as the textbook has it: absolute discounting, continuation counts for lower orders, interpolation down to a uniform share."""
    by_order = {ORDER: Counter({tuple(g): int(n) for g, n in zip(counts[0].tolist(), counts[1])})}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = Counter(g[1:] for g in by_order[k + 1])
    by_order = {k: Counter({g: n for g, n in c.items() if g[-1] != langid.BOS}) for k, c in by_order.items()}
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, c in by_order.items():
        n1, n2 = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for g, n in c.items():
            total[g[:-1], k] += n
            kinds[g[:-1], k] += 1

    def p(gram):
        k, context = len(gram), gram[:-1]
        if not k:
            return 1 / (every_char + 1)
        if not total[context, k]:
            return p(gram[1:])
        n, d = by_order[k][gram], discount[k]
        return ((n - d if n else 0) + d * kinds[context, k] * p(gram[1:])) / total[context, k]

    return p


def test_values_against_brute_force(docs):
    texts = defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        if r.lang and len(texts[r.lang]) < 3:
            texts[r.lang].append(r.text[:400])
    texts["a"], texts["b"] = ["abra cadabra", "abab ab ba"], ["xyz yzx zyx", "xx yy zz"]
    langs = sorted(texts)
    counts = {k: gram_counts(v) for k, v in texts.items()}
    m = fit(langs, counts)
    every_char = len({g[-1] for c, _ in counts.values() for g in c.tolist()})
    brute = {k: brute_kneser_ney(counts[k], every_char) for k in langs}
    said = [texts[k][0] for k in langs] + ["qqq of the zzz", "абв the"]
    for text in said:
        codes, _ = letters([text])
        got = m.log_probs(codes)
        for at in range(len(codes) - ORDER + 1):
            gram = tuple(codes[at : at + ORDER].tolist())
            for j, k in enumerate(langs):
                assert math.isclose(got[at, j], math.log(brute[k](gram)), rel_tol=1e-4, abs_tol=1e-4), (text, at, k)
    ce, _, n, _ = m.score(said)
    for i, text in enumerate(said):
        codes, _ = letters([text])
        for j, k in enumerate(langs):
            want = -sum(math.log(brute[k](tuple(codes[a : a + ORDER].tolist()))) for a in range(len(codes) - ORDER + 1)) / n[i]
            assert math.isclose(ce[i, j], want, rel_tol=1e-4)


def test_probabilities_sum_to_one():
    texts = {"a": ["abra cadabra", "abab ab ba"], "b": ["xyz yzx zyx", "xx yy zz"]}
    counts = {k: gram_counts(v) for k, v in texts.items()}
    m = fit(["a", "b"], counts)
    alphabet = sorted({c for g, _ in counts.values() for c in g[:, -1].tolist()})
    for context in ("abr", "xyz", "zab", "qqq"):
        codes = np.array([[*map(ord, context), c] for c in alphabet], dtype=np.uint32)
        total = sum(np.exp(m.log_probs(row).astype(float)) for row in codes)[0]
        assert np.all(total < 1 + 1e-4) and np.all(total > 0.6)  # the rest is for unknown characters


def test_pieces_do_not_matter(model, monkeypatch):
    texts = ["Of the thing and there. " * 300, "le la", "x"]
    whole = model.score(texts)
    monkeypatch.setattr(langid, "_PIECE_CELLS", 1)
    monkeypatch.setattr(langid, "_PIECE_LEAST", 997)
    pieces = model.score(texts)
    for a, b in zip(whole, pieces):
        assert np.allclose(a, b, rtol=1e-5)


def test_rejects_foreign_scripts_and_keeps_columns(make_docs, docs, model):
    rows = [(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5), (2, docs.first().text), (3, None), (4, "12 34 !!"), (5, ""), (2, docs.first().text)]
    frame = make_docs(rows).withColumn("score", F.lit("clash"))
    assert [r.doc_id for r in keep_accepted(frame, model).orderBy("doc_id").collect()] == [2, 2]
    assert keep_accepted(frame, model).columns == frame.columns
    got = {r.doc_id: r for r in predict(frame, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and not got[1].accepted


FOREIGN = [
    "Hyvää huomenta kaikille, tänään puhumme siitä miten kielet eroavat toisistaan ja miksi niiden tunnistaminen on tärkeää.",
    "Dzień dobry wszystkim, dzisiaj porozmawiamy o tym, czym różnią się języki i dlaczego ich rozpoznawanie jest ważne.",
    "Herkese günaydın, bugün dillerin birbirinden nasıl farklı olduğunu ve neden tanınmalarının önemli olduğunu konuşacağız.",
    "Chào buổi sáng mọi người, hôm nay chúng ta sẽ nói về sự khác nhau giữa các ngôn ngữ và vì sao điều đó quan trọng.",
    "Sanibonani nonke, namuhla sizokhuluma ngokuthi izilimi zihluka kanjani nokuthi kungani kubalulekile ukuzazi.",
    "xq zkvj wqpf jjxk vvzq qqwk zxcv bnmq wkrj xvqz kkjq zzxw qqjx vkzq",
]


def test_planted_foreign_texts_go_and_clean_ones_stay(make_docs, docs, model):
    clean = [r.text for r in docs.collect()]
    rows = [(i, t) for i, t in enumerate(clean)] + [(10_000 + i, t * k) for i, (t, k) in enumerate((t, k) for t in FOREIGN for k in (1, 40))]
    kept = {r.doc_id for r in keep_accepted(make_docs(rows), model).select("doc_id").collect()}
    assert kept == set(range(len(clean)))


def test_no_language_is_lost(make_docs):
    """Neither one with long texts only, nor one whose rows are all in the calibration fold."""
    def in_fold(k, start):
        return [i for i in range(start, start + 400) if zlib.crc32(str(i).encode()) % 5 == k]

    english = "the thing and there with the other thing "
    german = "der hund und die katze sind nicht im garten "
    french = "le chat et les chiens ne sont pas dans la maison "
    rows = [(i, english, "en") for k in (1, 2, 3) for i in in_fold(k, 0)[:20]]
    rows += [(i, german * (TRAIN_CHARS // len(german) + 9), "de") for i in in_fold(2, 400)[:5]]
    rows += [(i, french, "fr") for i in in_fold(1, 800)[:4]]
    frame = make_docs(rows)
    sample = training_sample(frame).collect()
    assert max(len(r.text) for r in sample) == TRAIN_CHARS and {r.lang for r in sample if not r.calibrates} == {"en", "de", "fr"}
    m = train(frame)
    assert m.langs == ["de", "en", "fr"]
    assert m.decide([german, english, french])[0] == ["de", "en", "fr"]


def test_rejection_rate():
    """For exponential residuals the limit is the quantile that the rate asks for."""
    residuals = np.random.default_rng(3).exponential(2.0, 20_000)
    assert rejection_limit(residuals) == pytest.approx(-2.0 * math.log(FALSE_REJECTION), rel=0.15)
    assert rejection_limit(residuals, 1e-3) == pytest.approx(np.quantile(residuals, 1 - 1e-3), rel=0.1)


def test_nothing_to_learn_from(make_docs):
    frame = make_docs([(1, "abc", None), (None, "x", None)])
    assert {r.lang_pred for r in predict(frame).collect()} == {"und"}
    assert predict(make_docs([])).collect() == []
