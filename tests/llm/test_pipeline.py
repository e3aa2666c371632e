from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm.langid import predict
from citeloom.llm.mixing import mix
from tests.llm.test_decontamination import brute
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_against_brute_force(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in rows.collect()}
        if name == "language_id":
            want = {r.doc_id for r in predict(rows).collect() if r.accepted}
            assert len(want) > 0.95 * len(before)
        elif name == "near_duplicates":
            want = {d for d, c in brute_components([(d, brute_print(r.text)) for d, r in before.items()]).items() if d == c}
        elif name == "decontamination":
            hits = brute([(d, r.text) for d, r in before.items()], [(r.item_id, r.text) for r in items])
            want = set(before) - {d for d, _ in hits}
        elif name == "source_mixing":
            want = {r.doc_id for r in mix(rows).collect() if r.kept}
        else:
            want = set(before)
        rows = stage(spark, rows, sf)
        got = rows.collect()
        assert len(got) == len(want) and {r.doc_id for r in got} == want
        if name == "sharding":
            assert {"shard", "slot"} <= set(rows.columns)
        else:
            assert rows.columns == docs.columns
            assert all(r == before[r.doc_id] for r in got)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "short one"), (None, "a text without an id, and some words of the thing"), (None, None)]


def stage_cases(make_docs, docs):
    """The table with odd rows: nulls in every column, repeated rows, a long text, copies."""
    own = [(r.doc_id + 1000, r.text, r.lang, r.source) for r in docs.orderBy("doc_id").limit(40).collect()]
    odd = [(t[0], t[1], lang, source) for t in EDGES for lang, source in (("en", "s"), (None, None))]
    more = [own[0], own[0], (5000, own[1][1] * 60, "en", None), (5001, own[2][1], None, "other"), (5002, own[2][1], "de", "s")]
    return make_docs(own + odd + more)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf, make_docs, docs, name, stage):
    frame = stage_cases(make_docs, docs)
    for extra in ((), ("score", "fp", "item_id", "weight", "topic", "hilbert")):
        odd = frame
        for c in extra:
            odd = odd.withColumn(c, F.lit("clash"))
        before, got = odd.collect(), stage(spark, odd, sf).collect()
        if name == "sharding":
            assert len(got) == len(before)
            continue
        counts, kept = Counter(before), Counter(got)
        assert not kept - counts  # no row is made up, changed or doubled
        assert all(n == counts[r] for r, n in kept.items() if r.doc_id is not None)  # repeated rows share their fate
        blank = [r for r in got if not (r.text or "").strip()]
        if name in ("language_id", "source_mixing"):
            assert not blank
        if name == "near_duplicates":
            assert {r.doc_id for r in blank} == {1, None} and {5001, 5002} & {r.doc_id for r in got} == set()
        if name == "decontamination":
            assert len(blank) == sum(not (r.text or "").strip() for r in before)
    empty = make_docs([])
    assert stage(spark, empty, sf).collect() == []
    assert name == "sharding" or stage(spark, empty, sf).columns == empty.columns
