import random
from collections import defaultdict
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from citeloom.llm.simhash import LIST_LIMIT, MIN_LISTS, PLACES, drop_near_duplicates, links, near_duplicate_classes


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: [(doc_id, fp)] -> component by doc_id."""
    up = {d: d for d, _ in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, fa) in enumerate(prints):
        for b, fb in prints[:i]:
            if (fa ^ fb).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: find(d) for d, _ in prints}


def test_whole_table(docs):
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicate_classes(docs).collect()}
    assert got == {d: (f"{fp:016x}", want[d]) for d, fp in prints}
    kept = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    assert kept == {d for d, c in want.items() if d == c}


def test_shared_lists_tell_shared_bytes():
    """Whichever bytes differ: the retained pairs are those with six or more equal bytes, no more and no fewer."""
    for n in range(9):
        for differing in combinations(range(8), n):
            shared = sum(not set(c) & set(differing) for c in PLACES)
            assert (shared >= MIN_LISTS) == (n <= 2)


def signed(p):
    return p - (1 << 64 if p >> 63 else 0)


def test_dense_clusters_of_every_size(spark):
    """Around the limit of a list, with links of which some lists are long and others short."""
    rnd = random.Random(17)
    prints = set()
    for size in (2, LIST_LIMIT - 1, LIST_LIMIT, LIST_LIMIT + 1, 4 * LIST_LIMIT):
        base = rnd.getrandbits(64)
        low = [rnd.randrange(1 << 32) for _ in range(size)]  # the upper four bytes are shared by all, so one list is long
        prints |= {base >> 32 << 32 | x for x in low}
        for x in low[: size // 2]:
            p = base >> 32 << 32 | x
            prints |= {p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64), p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)}
    prints = list(enumerate(sorted(prints, key=lambda p: (p * 2654435761) % 1000003)))
    want = brute_components(prints)
    from citeloom.llm.components import connected_components

    nodes = spark.createDataFrame([(signed(p), i) for i, p in prints], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(links(nodes)).collect()}
    assert {i: got.get(i, i) for i, _ in prints} == want


def test_long_lists_and_chains(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    prints = {base}
    for _ in range(120):  # one dense cluster, some of it in chains
        x = rnd.choice(sorted(prints))
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(200)}
    prints = [(i, p) for i, p in enumerate(sorted(prints, key=lambda p: (p * 2654435761) % 1000003))]
    want = brute_components(prints)
    nodes = spark.createDataFrame([(p - (1 << 64 if p >> 63 else 0), i) for i, p in prints], "fp long, rep long")
    from citeloom.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(links(nodes)).collect()}
    assert {i: got.get(i, i) for i, _ in prints} == want


def test_edges(make_docs):
    rows = [(7, None), (3, ""), (5, " \t"), (9, "One two"), (1, "one TWO"), (4, "É x y"), (6, "é x y"), (8, "w " * 200_000), (2, "w " * 200_001), (2, "w " * 200_001), (None, "zz")]
    got = near_duplicate_classes(make_docs(rows).withColumn("fp", F.lit(0)).withColumn("component_id", F.lit("c"))).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert len(got) == len(rows)
    assert by[7] == by[3] == by[5] == {3} and by[9] == by[1] == {1} and by[8] == by[2] == {2}
    assert by[4] == {4} and by[6] == {6} and by[None] == {None}
    assert near_duplicate_classes(make_docs([])).collect() == []
