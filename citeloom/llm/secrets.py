"""Secret scan: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import let, materialize, table

#: Fixed values of the contract: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What may hold a secret beside them: a run of this many or more token characters; so many are scored together.
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: An ordinary identifier is a shorter run of them.
IDENTIFIER = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{2,{LEAST - 1}}}(?![A-Za-z0-9+/_=-])"
#: Learning: documents that give labelled samples at most, and one sample in so many is held out to set the threshold.
TRAIN_DOCS = 20_000
HELD_OUT = 5
#: The threshold is such that this share of held-out ordinary strings would be reported.
FALSE_RATE = 1e-3
#: Ordinary strings to set it with are so many neighbouring identifiers, joined as paths and names are.
JOINED = 5
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N, _MARKS = len(_CHARS), _CHARS.index("+")
_BLOCK = 32
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Model:
    """log(P(next | last, random) / P(next | last, ordinary)) by pair of characters, and the least mean that is reported."""

    ratios: list[float]
    threshold: float


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What ``op`` gives for all elements before each element of an array.

    ``op`` is associative. Appending to an array copies it, so this goes by
    blocks, and then over the blocks: the time is nearly linear.
    """

    def fold(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("seen"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK)), lambda i: fold(F.slice(xs, i, F.lit(_BLOCK))))

    def joined_up(done: Column) -> Column:
        before = fold(F.transform(done, lambda d: d["at"]))["seen"]
        return F.flatten(F.zip_with(done, before, lambda d, b: F.transform(d["seen"], lambda s: op(b, s))))

    return let(let(values, blocks), joined_up)


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, values: bool = False) -> Column:
    """array<struct<start, rank, end, kind, value>> of the leftmost non-overlapping matches that are long enough.

    Places are code points: running sums of the lengths of the matches and of
    what lies between them. ``value`` is the match if asked for.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole, lambda m: F.length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    matched = F.zip_with(whole, sizes, lambda m, k: F.struct(m.alias("m"), k.alias("k")))
    parts = F.zip_with(matched, gaps, lambda x, g: F.struct(g.alias("gap"), F.length(x["m"]).alias("n"), x["k"].alias("size"), (x["m"] if values else F.lit(None).cast("string")).alias("value")))
    rank = [k for k, *_ in KINDS].index(kind) if kind != "markov" else len(KINDS)

    def placed(ps: Column) -> Column:
        before = running(F.transform(ps, lambda p: p["gap"] + p["n"]), lambda a, b: a + b, F.lit(0))

        def span(p: Column, b: Column) -> Column:
            start = b + p["gap"]
            own = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value"))
            return F.when(p["size"] >= least, own)

        return F.array_compact(F.zip_with(ps, before, span))

    return let(F.filter(parts, lambda p: p["n"].isNotNull()), placed).cast(_SPAN)


def base_spans(text: Column) -> list[Column]:
    """The spans of each kind; a text without a match is not taken apart."""
    none = F.array().cast(_SPAN)
    out = []
    for kind, pattern, group, least in KINDS:
        # For runs of one class, a long enough match is the same as a match of the long form.
        test = pattern if group else pattern[:-1] + f"{{{least - (4 if kind == 'access' else 0)},}}"
        used = pattern if group else test
        out.append(F.when(text.rlike(test), spans_of(text, kind, used, group, least)).otherwise(none))
    return out


def apart(tokens: Column, base: Column) -> Column:
    """The tokens (in order, none over another) that lie over no base span.

    Starts of base spans and ends of tokens are sorted together; a token is
    hit if a base span that starts before its end reaches beyond its start.
    """
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("sort"), b["end"].alias("reach")))
    ends = F.transform(tokens, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("sort"), F.lit(-1).alias("reach")))

    def free(events: Column) -> Column:
        reached = running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b), F.lit(-1))
        before = F.filter(F.zip_with(events, reached, lambda e, r: F.when(e["sort"] == 0, r)), lambda r: r.isNotNull())
        return F.array_compact(F.zip_with(tokens, before, lambda t, r: F.when(r <= t["start"], t)))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(F.array_sort(F.concat(starts, ends)), free))


def _pairs(value: Column) -> Column:
    """Indexes of the character pairs of a string in a table of _N * _N cells; null where a character is another one."""
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_CHARS), c) - 1)
    index = let(at, lambda a: F.zip_with(a, F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.when((x >= 0) & (y >= 0), x * _N + y)))
    return F.slice(index, F.lit(1), F.greatest(F.length(value) - 1, F.lit(0)))


def labelled_samples(docs: DataFrame, limit: int = TRAIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """((value, random, n), (value)): distinct labelled strings with their counts; ordinary strings of several identifiers.

    They come from a bounded sample of the documents, chosen by a hash of the
    id. What the base patterns find (values of assignments, access keys and
    hexadecimal runs of 16 characters or more) are random strings; other runs
    of fewer than LEAST token characters are ordinary identifiers. The second
    table joins JOINED neighbouring identifiers among the held-out ones.
    """
    total = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, limit / max(total, 1))))).where(F.col("text").isNotNull())
    text = F.col("text")
    found = [F.regexp_extract_all(text, F.lit(KINDS[0][1]), F.lit(1)), F.regexp_extract_all(text, F.lit(r"AKIA[A-Z0-9]{16,}"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"[0-9a-f]{24,}"), F.lit(0))]
    random = F.filter(F.flatten(F.array(*found)), lambda v: F.length(v) >= 16)
    plain = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    both = chosen.select(F.inline(F.array(F.struct(F.lit(True).alias("random"), random.alias("v")), F.struct(F.lit(False).alias("random"), plain.alias("v")))))
    values = both.select("random", F.explode("v").alias("value")).groupBy("random", "value").agg(F.count("*").alias("n"))
    mine = F.filter(plain, lambda v: F.pmod(F.xxhash64(v), F.lit(HELD_OUT)) == 0)
    several = let(mine, lambda m: F.transform(F.sequence(F.lit(1), F.greatest(F.size(m), F.lit(1)), F.lit(JOINED)), lambda i: F.array_join(F.slice(m, i, F.lit(JOINED)), "-")))
    return values, chosen.select(F.explode(several).alias("value")).where(F.length("value") >= LEAST)


def log_ratios(samples: DataFrame) -> list[float]:
    """log(P(next | last, random) / P(next | last, ordinary)) for each character pair, row by row.

    ``samples`` has value, random and n. Both models are first-order chains
    with add-half smoothing over the same characters; random strings use no
    order, so theirs is mixed evenly with a chain in which all characters are
    alike. Two marks in a row (rulers of dashes) say nothing either way.
    """
    counts = samples.select("random", "n", F.explode(_pairs(F.col("value"))).alias("pair")).where("pair IS NOT NULL").groupBy("pair")
    counts = counts.agg(F.sum(F.when(F.col("random"), F.col("n"))).alias("random"), F.sum(F.when(~F.col("random"), F.col("n"))).alias("plain"))
    cells = samples.sparkSession.range(_N * _N).select(F.col("id").alias("pair"), F.expr(f"id div {_N}").alias("last")).join(F.broadcast(counts), "pair", "left")
    cells = cells.select("pair", "last", *[(F.coalesce(c, F.lit(0)) + 0.5).alias(c) for c in ("random", "plain")])
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy("last"))
    ratio = F.log((0.5 * share("random") + 0.5 / _N) / F.greatest(share("plain"), F.lit(1e-4)))
    ratio = F.when((F.col("last") >= _MARKS) & (F.col("pair") % _N >= _MARKS), 0.0).otherwise(ratio)
    return [r.ratio for r in cells.select("pair", ratio.alias("ratio")).orderBy("pair").collect()]  # _N * _N rows


def best_mean(value: Column, ratios: list[float]) -> Column:
    """The largest mean log-likelihood ratio of LEAST neighbouring characters of a string; minus infinity if it is shorter.

    So an ordinary path or name before a key or behind it does not weigh it
    down. Sums of the stretches are differences of running sums.
    """
    known = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    gains = F.transform(_pairs(value), lambda i: F.coalesce(F.get(known, i), F.lit(-99.0)))
    sums = running(F.concat(gains, F.array(F.lit(0.0))), lambda a, b: a + b, F.lit(0.0))
    ahead = let(sums, lambda s: F.zip_with(F.slice(s, F.lit(LEAST), F.size(s)), s, lambda b, a: b - a))
    best = F.array_max(F.filter(ahead, lambda d: d.isNotNull())) / (LEAST - 1)
    return F.when(F.length(value) >= LEAST, best).otherwise(F.lit(float("-inf")))


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """The models of labelled samples, with the threshold that held-out ordinary strings set.

    One distinct string in HELD_OUT is not learnt from. Without a random
    string nothing can be reported.
    """
    values, several = (materialize(t, "secret-samples") for t in labelled_samples(docs, limit))
    learnt = values.where(F.pmod(F.xxhash64("value"), F.lit(HELD_OUT)) != 0)
    if not learnt.where("random").limit(1).count():
        return Model([-99.0] * (_N * _N), 0.0)
    ratios = log_ratios(learnt)
    at = several.select(best_mean(F.col("value"), ratios).alias("m")).agg(F.percentile_approx("m", 1 - FALSE_RATE, 100_000)).first()[0]
    return Model(ratios, max(float(at), 0.0) if at is not None else 0.0)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind) in code points for every row of ``docs``.

    ``base`` holds the matches of the fixed patterns. ``spans`` adds, as kind
    ``markov``, runs of LEAST or more token characters that lie over no base
    span and have LEAST neighbouring characters whose mean log-likelihood
    ratio is above the threshold; equal to it is not above. The model is
    learnt from labelled_samples of ``docs`` if none is given.

    Whole texts are scanned, and in time nearly linear in their length and
    matches. A null or empty text has no spans; repeated rows and null ids are
    each returned; spans with one start are in the order of KINDS; an empty
    table gives no rows; columns other than doc_id and text, whatever their
    names, are not read.
    """
    model = model or train(docs)
    none = F.array().cast(_SPAN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = F.array_sort(F.concat(*base_spans(F.col("text"))))
    tokens = F.when(F.col("text").rlike(TOKEN), spans_of(F.col("text"), "markov", TOKEN, 0, LEAST, values=True)).otherwise(none)

    def added(ts: Column, b: Column) -> Column:
        return F.filter(apart(ts, b), lambda t: best_mean(t["value"], model.ratios) > model.threshold)

    def places(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    def result(b: Column) -> Column:
        more = F.when(F.size(F.col("tokens")) > 0, let(F.col("tokens"), lambda ts: added(ts, b))).otherwise(none)
        return F.struct(places(b).alias("base"), places(F.array_sort(F.concat(b, more))).alias("spans"))

    found = rows.select("doc_id", base.alias("base"), tokens.alias("tokens"))
    return found.select("doc_id", let(F.col("base"), result).alias("r")).select("doc_id", "r.base", "r.spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
