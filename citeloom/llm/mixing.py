"""Mixing of sources: iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import broadcast_if_small, let, materialize, table

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: the marginals of the cells with their tokens to this power.
ALPHA = 0.7
#: Share of all tokens that the sample should hold.
KEEP = 0.7
#: Fitting ends when no share is off its target by more than TOLERANCE, or after so many steps; a share off by more than UNMET is an error then.
TOLERANCE, UNMET, ROUNDS_A_STEP, MAX_STEPS = 1e-6, 1e-4, 2, 60
#: Up to so many cells (of some 100 bytes each) are fitted without a shuffle.
ONE_TASK = 100_000
SEED = 7
#: Topics are learnt over so many hashed terms, until a round raises the likelihood by less than this share, or so often.
TOPICS, TERMS, LEARNING_GAIN, LEARNING_ROUNDS = 6, 512, 1e-3, 12


def _words(text: Column) -> Column:
    """Runs without ASCII white space; an empty string may stand at the ends."""
    return F.split(text, r"[\x20\x09-\x0D]+")


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def terms(text: Column) -> Column:
    """The distinct hashed terms of a text, words without regard to case and order."""
    hashed = F.transform(_words(F.lower(text)), lambda w: F.when(w != "", F.pmod(F.xxhash64(w), F.lit(TERMS)).cast("int")))
    return F.array_distinct(F.filter(hashed, lambda t: t.isNotNull()))


@dataclass(frozen=True)
class Topics:
    """log p(term | topic), times the weight of the term, and log p(topic) of a mixture in which each document has one topic."""

    terms: list[list[float]]
    topics: list[float]

    def of(self, found: Column) -> Column:
        """The likeliest topic of a document with the terms ``found``; the first of several, and of a document without a term."""
        tables = [F.split(F.lit(",".join(f"{x:.6f}" for x in row)), ",").cast("array<double>") for row in self.terms]
        names = [f"s{k}" for k in range(len(tables))]
        state = lambda values: F.named_struct(*[x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v)])
        scores = F.aggregate(found, state([F.lit(x) for x in self.topics]), lambda acc, t: state([acc[n] + F.get(row, t) for row, n in zip(tables, names, strict=True)]))

        def best(s: Column) -> Column:
            most, out = F.greatest(*[s[n] for n in names]), F.lit(f"t{len(names) - 1}")
            for k in range(len(names) - 2, -1, -1):
                out = F.when(s[names[k]] == most, f"t{k}").otherwise(out)
            return F.when(F.size(found) > 0, out).otherwise(F.lit("t0"))

        return let(scores, best)


def learn_topics(rows: DataFrame, n: int = TOPICS) -> Topics:
    """Topics of all documents by their ``terms``: a mixture of unigrams over hashed terms, fitted by hard EM.

    A term weighs log(documents / documents with it), by the largest of these:
    what stands in all documents of a language says little. Documents begin in
    the topic that the hash of their rarest term names. Each round counts
    (topic, term), a table of a bounded size, and assigns each document inside
    its row; documents are not shuffled. Rounds end when the weighted
    likelihood grows by less than LEARNING_GAIN of it.
    """
    seen = F.concat("terms", F.array(F.lit(TERMS)))  # beyond the last term: the documents themselves
    df = [0] * (TERMS + 1)
    for r in rows.select(F.explode(seen).alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # TERMS + 1 rows at most
        df[r.t] = r.df
    rarity = [log((df[TERMS] + 1) / (x + 0.5)) for x in df[:TERMS]]
    weights = [x / max(rarity) for x in rarity]
    known = F.split(F.lit(",".join(map(str, df))), ",").cast("array<bigint>")
    rarest = F.array_min(F.transform("terms", lambda t: F.named_struct(F.lit("df"), F.get(known, t), F.lit("h"), F.xxhash64(t))))
    topic = F.concat(F.lit("t"), F.coalesce(F.pmod(rarest["h"], F.lit(n)), F.lit(0)).cast("string"))
    model, reached = None, float("-inf")
    for _ in range(LEARNING_ROUNDS):
        # Inside the array, so that a topic is found once a document and not once a term.
        pairs = let(topic, lambda k: F.transform(seen, lambda t: F.named_struct(F.lit("topic"), k, F.lit("t"), t)))
        counts = rows.select(F.inline(pairs)).groupBy("topic", "t").agg(F.count("*").alias("n")).collect()  # n * (TERMS + 1) rows at most
        found, sizes = [[0] * TERMS for _ in range(n)], [0] * n
        for r in counts:
            if r.t < TERMS:
                found[int(r.topic[1:])][r.t] += r.n
            else:
                sizes[int(r.topic[1:])] += r.n
        chances = [_logs([w * (x + 0.5) for w, x in zip(weights, row, strict=True)]) for row in found]
        model = Topics([[w * x for w, x in zip(weights, row, strict=True)] for row in chances], _logs([x + 1 for x in sizes]))
        likely = sum(x * y for row, times in zip(model.terms, found, strict=True) for x, y in zip(row, times, strict=True)) + sum(x * y for x, y in zip(model.topics, sizes, strict=True))
        if likely - reached < LEARNING_GAIN * abs(likely):
            break
        reached = likely
        topic = model.of(F.col("terms"))
    return model


def _logs(values: list[float]) -> list[float]:
    total = log(sum(values))
    return [log(v) - total for v in values]


def _metadata(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang", *(["topic"] if "topic" in docs.columns else []))]


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, keep: float | None = None) -> DataFrame:
    """Adds ``weight`` and ``off`` to ``cells`` (source, lang, topic, tokens): token weights, sum 1, with the target marginals.

    With ``keep`` no weight exceeds tokens / (keep * all tokens): a sample of
    that share of the tokens can then have just these marginals. ``targets``
    gives shares by category for some or all dimensions; others aim at the
    marginals of tokens to the power ``alpha``, under the same bound, which
    can always be met together. Categories that a given mapping lacks get the
    share 0; shares are scaled to sum 1 over those present. ``off`` is what
    the worst share of the cell's three categories misses.

    Each round scales the weights to each dimension in turn, by sums that are
    grouped by its categories; the factor of a category is the one at which
    its weights, bounded, reach the target. ROUNDS_A_STEP rounds are one job
    and a written table. Up to ONE_TASK cells are dealt to one task, more are
    shuffled by the dimension at hand. If given targets cannot be met together,
    ValueError says by how much. Without any, the bounded powers themselves,
    which have the marginals, stand in for weights that come to no end.
    """
    c = cells.where("tokens > 0").select(*DIMENSIONS, "tokens")
    n, total = c.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return c.withColumns({"weight": F.lit(0.0), "off": F.lit(0.0)})
    c = c.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(alpha)))
    c = calibrate(c, keep).withColumn("_aim", F.col("prob") * F.col("tokens")) if keep else c.withColumn("_aim", F.col("weight"))
    if n <= ONE_TASK:
        c = c.coalesce(1).sortWithinPartitions(*DIMENSIONS)
    aimed = c.agg(F.sum("_aim")).first()[0]
    bound = F.col("tokens") / F.lit(float(total) * keep) if keep else F.lit(float("inf"))
    c = c.select(*DIMENSIONS, "tokens", (F.col("_aim") / F.lit(aimed)).alias("_aim"), bound.alias("_most"), (F.col("tokens") / F.lit(float(total))).alias("_free"))
    for d in DIMENSIONS:
        if targets and d in targets:
            pairs = [x for k, v in targets[d].items() for x in (F.lit(k), F.lit(float(v)))]
            aim = F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0)) if pairs else F.lit(0.0)
            whole = cells.where("tokens > 0").select(d).distinct().agg(F.sum(aim)).first()[0]
            if not whole > 0:
                raise ValueError(f"no share for any {d} that occurs")
            c = c.withColumn(f"_t_{d}", aim / F.lit(whole))
        else:
            c = c.withColumn(f"_t_{d}", F.sum("_aim").over(Window.partitionBy(d)))
    for _ in range(MAX_STEPS):
        for _ in range(ROUNDS_A_STEP):
            for d in DIMENSIONS:
                c = _scaled(c, d, bool(keep))
        c = materialize(c.withColumn("weight", F.least("_free", "_most")).withColumn("off", _missed()), "rake")
        off = c.agg(F.max("off")).first()[0]
        if off < TOLERANCE:
            break
        c = c.coalesce(1) if n <= ONE_TASK else c
    if off > UNMET and targets:
        raise ValueError(f"the target shares cannot be met together: one is off by {off:.3g} after {MAX_STEPS * ROUNDS_A_STEP} rounds" + (f", of a sample of {keep:g} of the tokens" if keep else ""))
    if off > UNMET:
        c = c.withColumn("weight", F.col("_aim")).withColumn("off", _missed())
    return c.select(*DIMENSIONS, "tokens", "weight", "off")


def _scaled(c: DataFrame, d: str, bounded: bool) -> DataFrame:
    """Multiplies the free weights of each category of ``d`` so that what is below the bounds sums up to the target.

    Bounded sums are the least, over all prefixes of the cells by bound / free
    weight, of the prefix's bounds and the rest's scaled weights. So the factor
    is the largest of those that each prefix asks for.
    """
    whole = Window.partitionBy(d)
    rest = F.sum("_free").over(whole)
    factor = F.when(rest > 0, F.col(f"_t_{d}") / rest)
    if bounded:
        by_room = whole.orderBy(F.when(F.col("_free") > 0, F.col("_most") / F.col("_free")).asc_nulls_last(), *DIMENSIONS)
        c = c.withColumn("_held", F.sum("_most").over(by_room.rowsBetween(Window.unboundedPreceding, 0)))
        c = c.withColumn("_rest", F.sum("_free").over(by_room.rowsBetween(1, Window.unboundedFollowing)))
        c = c.withColumn("_factor", F.when(F.col("_rest") > 0, (F.col(f"_t_{d}") - F.col("_held")) / F.col("_rest")))
        factor = F.greatest(factor, F.max("_factor").over(whole))
    return c.withColumn("_free", F.col("_free") * F.coalesce(factor, F.lit(0.0))).drop("_held", "_rest", "_factor")


def _missed() -> Column:
    return F.greatest(*[F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"_t_{d}")) for d in DIMENSIONS])


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``prob``: inclusion probabilities in proportion to weight / tokens, 1 at most.

    The factor is such that the expected tokens of the sample are ``keep`` of
    all: cells that would exceed 1 are taken whole and the factor for the rest
    grows accordingly, until no further cell does. Each step is one sum.
    """
    ratio = F.col("weight") / F.col("tokens")
    goal = (raked.agg(F.sum("tokens")).first()[0] or 0) * keep
    factor = 0.0
    while True:
        whole = (ratio * F.lit(factor) >= 1) & (F.col("weight") > 0)
        held, rest = raked.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("weight")))).first()
        if not rest or held >= goal:
            factor = factor if rest else float("inf")
            break
        grown = (goal - held) / rest
        if grown <= factor * (1 + 1e-12):
            break
        factor = grown
    prob = F.when(F.col("weight") > 0, F.least(F.lit(1.0), ratio * F.lit(factor))).otherwise(F.lit(0.0))
    return raked.select(*raked.columns, prob.alias("prob"))


def shares(cells: DataFrame) -> DataFrame:
    """(dimension, category, tokens, share, target, expected) of calibrated cells: a category's share of all tokens, of the weights and of the sample's expected tokens."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in DIMENSIONS])
    sums = cells.select(F.explode(each).alias("k"), "tokens", "weight", (F.col("prob") * F.col("tokens")).alias("kept")).groupBy("k.dimension", "k.category").agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("target"), F.sum("kept").alias("kept"))
    of = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy("dimension"))
    return sums.select("dimension", "category", "tokens", of("tokens").alias("share"), "target", of("kept").alias("expected"))


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that the id and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mixing_plan(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): doc_id, row keys, dimensions and tokens of each document; the calibrated cells."""
    text = F.coalesce(F.col("text"), F.lit(""))
    learnt = "topic" not in docs.columns
    rows = docs.select("doc_id", *row_keys(docs), *_metadata(docs), tokens(text).alias("n_tokens"), *([terms(text).alias("terms")] if learnt else []))
    rows = materialize(rows, "mix-rows")
    if learnt:
        topic = learn_topics(rows).of(F.col("terms"))
        rows = materialize(rows.withColumn("topic", topic).drop("terms"), "mix-rows")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-tokens")
    return rows, materialize(calibrate(materialize(rake(cells, targets, keep=keep), "mix-raked"), keep), "mix-cells")


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes, 128 bits, of what decides a row's fate: its id, metadata and text."""
    told = [F.col("doc_id"), *_metadata(docs), F.col("text")]
    return [F.xxhash64(F.lit(k), *told).alias(f"_mix_key{k}") for k in (0, 1)]


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, prob, kept) for every row of ``docs``.

    ``weight`` is the document's share of the raked token weights (weight of
    its cell by tokens). A document is kept if its number in [0, 1) is below
    ``prob``. The topic is a column of that name where there is one, else it
    is learnt from the words of all texts.

    Null metadata are the category ''; null and blank texts have no tokens,
    weight 0 and probability 0 and are not kept; very long texts count whole;
    repeated rows share their fate; of topics that are equally likely the
    first is taken; targets that cannot be met together by a sample of ``keep``
    of the tokens, in which nothing is taken twice, are a ValueError; an empty
    table gives no rows; only doc_id, text, source, lang and, where
    present, topic are read, whatever other columns are named.
    """
    rows, cells = mixing_plan(docs, targets, keep)
    out = rows.join(broadcast_if_small(cells), list(DIMENSIONS), "left")
    share = F.coalesce(F.col("weight") * F.col("n_tokens") / F.col("tokens"), F.lit(0.0))
    prob = F.when(F.col("n_tokens") > 0, F.coalesce(F.col("prob"), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", share.alias("weight"), prob.alias("prob")).withColumn("kept", chance(F.col("doc_id")) < F.col("prob"))


def sample_mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """The kept documents, with the columns of ``docs``; the cases are those of ``mix``.

    So null and blank texts go, null metadata are a category, repeated rows
    (and all rows with a null id in one cell) share their fate, and an empty
    table stays empty; columns of any name pass through.
    """
    rows, cells = mixing_plan(docs, targets, keep)
    keys = ["_mix_key0", "_mix_key1"]
    kept = rows.where("n_tokens > 0").join(broadcast_if_small(cells.select(*DIMENSIONS, "prob")), list(DIMENSIONS)).where(chance(F.col("doc_id")) < F.col("prob"))
    marked = docs.withColumns(dict(zip(keys, row_keys(docs), strict=True)))
    return marked.join(kept.select(*keys), keys, "left_semi").select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
