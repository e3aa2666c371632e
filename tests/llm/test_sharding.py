import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import product

from pyspark.sql import functions as F

from citeloom.llm.sharding import BITS, hilbert_index, hilbert_shards, op5_hilbert_shards, write_shards


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (3, 1), (1, 4)):
        side = 1 << bits
        axes = [F.expr(f"cast(id div {side**i} % {side} as int)") for i in range(n)]
        rows = spark.range(side**n).select(hilbert_index(axes, bits).alias("h"), F.array(*axes).alias("x")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(side**n))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(p - q) for p, q in zip(a.x, b.x)) == 1


def curve(n, bits):
    """The cells of the curve in order, by the Gray-code recursion on rotated and reflected subcubes."""
    if bits == 0:
        return [(0,) * n]

    def rotl(x, k, width):
        k %= width
        return ((x << k) | (x >> (width - k))) & ((1 << width) - 1)

    def walk(level, entry, direction):
        for i in range(1 << n):
            g = rotl(i ^ (i >> 1), direction + 1, n) ^ entry
            if level == 1:
                yield (g,)
                continue
            e = 0 if i == 0 else ((2 * ((i - 1) // 2)) ^ (2 * ((i - 1) // 2) >> 1))
            d = 0 if i == 0 else ((~(i - 1 if i % 2 == 0 else i) & (i if i % 2 == 0 else i + 1)).bit_length() - 1)
            for rest in walk(level - 1, entry ^ rotl(e, direction + 1, n), (direction + d + 1) % n):
                yield (g, *rest)

    return [tuple(sum((g >> axis & 1) << (bits - 1 - k) for k, g in enumerate(steps)) for axis in range(n)) for steps in walk(bits, 0, 0)]


def congruent(a, b, n):
    """Whether one order of cells is the other under some exchange and reflection of axes."""
    from itertools import permutations

    side = max(max(x) for x in a)
    for perm in permutations(range(n)):
        for flips in product((0, 1), repeat=n):
            if all(tuple(side - x[p] if f else x[p] for p, f in zip(perm, flips)) == y for x, y in zip(a, b)):
                return True
    return False


def test_curve_is_the_recursive_one_in_the_plane(spark):
    side = 8
    axes = [F.expr(f"cast(id div {side**i} % {side} as int)") for i in range(2)]
    rows = [tuple(r.x) for r in spark.range(64).select(hilbert_index(axes, 3).alias("h"), F.array(*axes).alias("x")).orderBy("h").collect()]
    assert congruent(curve(2, 3), rows, 2)


def brute_levels(values):
    counts, out, before = Counter(values), {}, 0
    for v in sorted(counts, key=lambda s: s.encode()):
        out[v] = before * (1 << BITS) // len(values)
        before += counts[v]
    return out


def test_cells_and_order_against_brute_force(spark, docs):
    """Every row's cell is recomputed from the table, and its place from the cell."""
    rows = docs.collect()
    lang, source = (brute_levels([r[c] or "" for r in rows]) for c in ("lang", "source"))
    first = {}
    for r in rows:
        first[r.text] = min(first.get(r.text, (r.lang or "", r.source or "")), (r.lang or "", r.source or ""))
    cells = {r.doc_id: (lang[first[r.text][0]], source[first[r.text][1]], min(max((len((r.text or "").encode()) + 1).bit_length() - 1 - 8, 0), 15)) for r in rows}
    every = spark.range(1 << 12).select(*[F.expr(f"cast(id div {16**i} % 16 as int)").alias(x) for i, x in enumerate("abc")])
    index = {(r.a, r.b, r.c): r.h for r in every.select("a", "b", "c", hilbert_index([F.col("a"), F.col("b"), F.col("c")], 4).alias("h")).collect()}
    got = {r.doc_id: r for r in hilbert_shards(docs).collect()}
    assert {d: r.hilbert for d, r in got.items()} == {d: index[c] for d, c in cells.items()}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(got, key=lambda d: (got[d].hilbert, hashes[d], d))
    cuts = [-(-s * len(order) // 16) for s in range(17)]
    for place, d in enumerate(order):
        shard = bisect_left(cuts, place + 1) - 1
        assert (got[d].shard, got[d].slot) == (shard, place - cuts[shard])


def test_copies_meet(spark, sf, docs):
    shards = defaultdict(set)
    text = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter(text.values())
    for r in op5_hilbert_shards(spark, sf).collect():
        shards[text[r.doc_id]].add(r.shard)
    assert sum(n > 1 for n in copies.values()) > 5 and sum(len(s) > 1 for s in shards.values()) <= 15
    assert all(max(s) - min(s) == len(s) - 1 for s in shards.values())


def test_written_shards_hold_every_row_once(spark, make_docs, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, None), (2, ""), *[(i, "text " * i, "en", f"s{i % 3}") for i in range(3, 60)]]
    frame = make_docs(rows).withColumn("slot", F.lit("clash")).withColumn("more", F.col("doc_id") * 2)
    write_shards(frame, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out")
    own = [c for c in frame.columns if c != "slot"]
    assert sorted(map(str, got.select(*own).collect())) == sorted(map(str, frame.select(*own).collect()))
    for shard in range(4):
        part = got.where(F.col("shard") == shard).collect()
        assert sorted(r.slot for r in part) == list(range(len(part))) and abs(len(part) - len(rows) / 4) < 1


def check(rows, texts, n_shards):
    by = Counter(r.shard for r in rows)
    assert set(by) <= set(range(n_shards))
    if rows:
        sizes = [by[s] for s in range(n_shards)]
        assert max(sizes) - min(sizes) <= 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_whole_table(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = hilbert_shards(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 16)


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (4, "é"), (4, "é"), (None, "a"), (5, "same", None, None), (6, "same", "en", None)]
    got = hilbert_shards(make_docs(rows).withColumn("shard", F.lit("clash")).withColumn("_rank", F.lit(1)), 3).collect()
    assert len(got) == len(rows)
    check(got, {r[0]: r[1] for r in rows}, 3)
    assert hilbert_shards(make_docs([]), 3).collect() == []
