"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, materialize, table
from citeloom.shipping import ship_package

ORDER = 4
#: Bounds of the training sample: documents of a language, and characters of each (a window that a hash of the id places).
TRAIN_DOCS = 1500
TRAIN_CHARS = 20_000
FOLDS = 5
CALIBRATION_FOLD = 1
#: A text of a known language is rejected with this probability. As no sample shows so rare a residual, the limit
#: follows from the largest TAIL of those in calibration, whose excess is taken for exponential.
FALSE_REJECTION, TAIL = 1e-8, 0.05
BOS, GAP, BASE = 0x110000, 0x20, 0x110001
UNDECIDED = "und"
_PIECE_CELLS, _PIECE_LEAST = 2_000_000, 1 << 14
_MULT = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or the gap for what is no letter."""
    if not _FOLD:
        out = np.full(BASE, GAP, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        out[BOS] = BOS
        _FOLD.append(out)
    return _FOLD[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): all texts folded, runs of gaps as one, each after ORDER - 1 start marks."""
    pad = ORDER - 1
    joined = "".join(["\x00" * pad + t for t in texts])
    codes = _fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    starts = np.concatenate([[0], np.cumsum([len(t) + pad for t in texts])])[:-1].astype(np.int64)
    for i in range(pad):
        codes[starts + i] = BOS
    gap = codes == GAP
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(gap[1:] & (gap[:-1] | (codes[:-1] == BOS)))
    places = np.cumsum(keep) - 1
    return codes[keep], places[starts]


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _MULT
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order``-grams that end at places order - 1 and after."""
    c = codes.astype(np.uint64)
    n = len(c) - order + 1
    h = np.full(max(n, 0), order, dtype=np.uint64)
    for i in range(order):
        h = _mix(h, c[i : i + n])
    return h


def row_hashes(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), grams.shape[1], dtype=np.uint64)
    for i in range(grams.shape[1]):
        h = _mix(h, grams[:, i].astype(np.uint64))
    return h


@dataclass
class Model:
    """Sorted hash arrays by order, each with a column of log values for each language."""

    langs: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    scale: float = 10.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """log p of each code from place ORDER - 1 on, by language."""
        n = len(codes) - ORDER + 1
        out = np.empty((max(n, 0), len(self.langs)), dtype=np.float32)
        rest = np.arange(max(n, 0))
        back = np.zeros((len(rest), len(self.langs)), dtype=np.float32)
        for k in range(ORDER, 0, -1):
            keys, values = self.grams[k]
            h = gram_hashes(codes, k)[ORDER - k :][rest]
            at, hit = _find(keys, h)
            out[rest[hit]] = back[hit] + values[at[hit]]
            rest, back = rest[~hit], back[~hit]
            if not len(rest):
                return out
            if k > 1:
                ckeys, cvalues = self.contexts[k]
                h = gram_hashes(codes[:-1], k - 1)[ORDER - k :][rest]
                at, hit = _find(ckeys, h)
                back[hit] += cvalues[at[hit]]
        out[rest] = back + self.floor
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropies by text and language, the same with the best language of each character, scored characters, has a letter)."""
        sums = np.zeros((len(texts), len(self.langs) + 1))
        counts, found = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        piece = max(_PIECE_LEAST, _PIECE_CELLS // (len(self.langs) + 8))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= piece):
                size += len(texts[end])
                end += 1
            group = texts[at:end]
            if end == at + 1 and size > piece:  # a long text: piece by piece, each with the end of the one before
                self._long(group[0], piece, at, sums, counts, found)
            else:
                codes, starts = letters(group)
                self._add(codes, starts, at, sums, counts, found)
            at = end
        ce = -sums / np.maximum(counts, 1)[:, None]
        return ce[:, :-1], ce[:, -1], counts, found

    def _add(self, codes, starts, at, sums, counts, found) -> None:
        own = np.diff(np.append(starts, len(codes))) - (ORDER - 1)
        logs = self.log_probs(codes)
        body = np.ones(len(codes), dtype=bool)
        for i in range(ORDER - 1):
            body[starts + i] = False
        doc = np.repeat(np.arange(len(starts)), own)
        logs = logs[body[ORDER - 1 :]]
        for k in range(len(self.langs)):
            sums[at : at + len(starts), k] += np.bincount(doc, weights=logs[:, k], minlength=len(starts))
        sums[at : at + len(starts), -1] += np.bincount(doc, weights=logs.max(axis=1), minlength=len(starts))
        counts[at : at + len(starts)] += own
        found[at : at + len(starts)] |= np.bincount(doc, weights=codes[body] != GAP, minlength=len(starts)) > 0

    def _long(self, text, piece, at, sums, counts, found) -> None:
        tail = np.full(ORDER - 1, BOS, dtype=np.uint32)
        for i in range(0, len(text), piece):
            codes, _ = letters(["a" + text[i : i + piece]])  # after a letter, a leading gap stays
            codes = codes[ORDER:]
            if len(codes) and codes[0] == GAP and tail[-1] in (GAP, BOS):
                codes = codes[1:]
            codes = np.concatenate([tail, codes])
            logs = self.log_probs(codes)
            sums[at, :-1] += logs.sum(axis=0, dtype=np.float64)
            sums[at, -1] += logs.max(axis=1).sum(dtype=np.float64)
            counts[at] += len(codes) - (ORDER - 1)
            found[at] |= bool((codes[ORDER - 1 :] != GAP).any())
            tail = codes[-(ORDER - 1) :]

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted) of each text; a text without a letter is undecided."""
        if not self.langs:
            return [UNDECIDED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        ce, top, n, found = self.score(texts)
        best = ce.argmin(axis=1)
        odds = np.exp(-self.scale * (ce - ce.min(axis=1, keepdims=True)))
        score = np.where(found, 1 / odds.sum(axis=1), 0.0)
        accepted = found & (self.residual(top, n, best) <= self.limit)
        return [self.langs[b] if f else UNDECIDED for b, f in zip(best, found, strict=True)], score, accepted

    def residual(self, top: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far a cross-entropy is beyond that of calibration texts. It is the one with the best language
        of each character, so that a text in two of the languages is not taken for a foreign one."""
        if self.mean is None:
            return np.zeros(len(top))
        return (top - self.mean[lang]) / (self.spread[lang] * (0.1 + 1 / np.sqrt(np.maximum(n, 1))))


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)


def fit(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from the ORDER-gram counts of each language: (grams as rows of codes, counts)."""
    every = {ORDER: np.unique(np.concatenate([counts[x][0] for x in langs]), axis=0)}
    for k in range(ORDER - 1, 0, -1):
        every[k] = np.unique(every[k + 1][:, 1:], axis=0)
    every[1] = every[1][every[1][:, 0] != BOS]
    floor = -np.log(len(every[1]) + 1.0)
    width = len(langs)
    model = Model(langs, {}, {}, np.full(width, floor, dtype=np.float32))
    level: dict[str, tuple[np.ndarray, np.ndarray]] = dict(counts)
    by_order = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before each shorter gram
        level = {x: np.unique(g[:, 1:], axis=0, return_counts=True) for x, (g, _) in level.items()}
        by_order[k] = level
    lower = None
    for k in range(1, ORDER + 1):
        grams = every[k]
        keys = row_hashes(grams)
        order = np.argsort(keys)
        keys, grams = keys[order], grams[order]
        if k == 1:
            values = np.full((len(keys), width), np.exp(floor))
        else:
            context_keys = row_hashes(grams[:, :-1])
            ckeys, inverse = np.unique(context_keys, return_inverse=True)
            backoff = np.ones((len(ckeys), width))
            at, hit = _find(lower[0], row_hashes(grams[:, 1:]))
            values = np.where(hit[:, None], lower[1][at], np.exp(floor))
        for j, x in enumerate(langs):
            g, n = by_order[k][x]
            mask = g[:, -1] != BOS
            g, n = g[mask], n[mask].astype(float)
            if not len(g):
                continue
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at, _ = _find(keys, row_hashes(g))
            own = np.zeros(len(keys))
            if k == 1:
                total, kinds = n.sum(), len(n)
                own[at] = (n - d) / total
                values[:, j] = own + d * kinds / total * np.exp(floor)
                model.floor[j] += np.log(d * kinds / total)  # what an unknown character gets
                continue
            place = inverse[at]
            total = np.bincount(place, weights=n, minlength=len(ckeys))
            kinds = np.bincount(place, minlength=len(ckeys))
            seen = total > 0
            backoff[seen, j] = d * kinds[seen] / total[seen]
            own[at] = (n - d) / total[place]
            values[:, j] = own + backoff[inverse, j] * values[:, j]
        if k > 1:
            model.contexts[k] = ckeys, np.log(backoff).astype(np.float32)
        model.grams[k] = keys, np.log(values).astype(np.float32)
        lower = keys, values
    return model


def calibrate(model: Model, truth: np.ndarray, ce: np.ndarray, top: np.ndarray, n: np.ndarray) -> Model:
    """Sets the scale of the scores and the limit of the residuals from texts of known language."""
    if not len(truth):
        return model
    own = ce[np.arange(len(truth)), truth]
    best = (np.inf, model.scale)
    for scale in (1, 2, 5, 10, 20, 50, 100, 200):
        loss = np.log(np.exp(-scale * (ce - own[:, None])).sum(axis=1)).mean()
        best = min(best, (loss, scale))
    model.scale = float(best[1])
    model.mean = np.array([np.median(top[truth == j]) if (truth == j).any() else np.median(top) for j in range(len(model.langs))])
    unit = (top - model.mean[truth]) / (0.1 + 1 / np.sqrt(np.maximum(n, 1)))
    model.spread = np.array([max(np.std(unit[truth == j]), 1e-3) if (truth == j).sum() > 1 else max(np.std(unit), 1e-3) for j in range(len(model.langs))])
    model.limit = rejection_limit(model.residual(top, n, truth))
    return model


def rejection_limit(residuals: np.ndarray, rate: float = FALSE_REJECTION) -> float:
    """The residual that texts like those of calibration exceed at ``rate``: a peaks-over-threshold estimate."""
    start = float(np.quantile(residuals, 1 - TAIL))
    beyond = residuals[residuals > start]
    return start + max(float((beyond - start).mean()) if len(beyond) else 0.0, 1.0) * float(np.log(TAIL / rate))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang in pc.unique(b.column(0)).to_pylist():
            texts = b.filter(pc.equal(b.column(0), lang)).column(1).to_pylist()
            for i in range(0, len(texts), 200):
                codes, _ = letters(texts[i : i + 200])
                h, first, n = np.unique(gram_hashes(codes, ORDER), return_index=True, return_counts=True)
                grams = [codes[first + j] for j in range(ORDER)]
                keep = grams[-1] != BOS
                columns = [pa.array([lang] * int(keep.sum()), type=pa.string()), *[pa.array(g[keep].astype(np.int32)) for g in grams], pa.array(n[keep].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", *[f"c{j}" for j in range(ORDER)], "n"])


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text, calibrates): a bounded sample of the labelled rows outside fold 0.

    About TRAIN_DOCS documents of each language, chosen by a hash of the id.
    Of a text of more than TRAIN_CHARS characters, so many are read, from a
    place that the same hash decides; so no language goes for the length of
    its texts. Rows of CALIBRATION_FOLD calibrate, but for those of a language
    that has no others.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    labelled = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", (fold(F.col("doc_id")) == CALIBRATION_FOLD).alias("calibrates"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("calibrates").alias("no_other")).collect()  # a row a language
    if not sizes:
        return labelled.select("lang", "text", "calibrates")
    by_lang = lambda value: F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(value(r)))]), F.col("lang"))
    h = F.xxhash64("doc_id")
    chosen = labelled.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < by_lang(lambda r: min(1.0, TRAIN_DOCS / r.n)))
    start = F.pmod(F.shiftrightunsigned(h, 30), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1) + 1
    window = F.substring(F.col("text"), start.cast("int"), F.lit(TRAIN_CHARS))
    return chosen.select("lang", window.alias("text"), (F.col("calibrates") & ~by_lang(lambda r: r.no_other)).alias("calibrates"))


def train(docs: DataFrame) -> Model:
    """Fits and calibrates the models on ``training_sample``. Their arrays take 4 bytes a known gram and language."""
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    chosen = materialize(training_sample(docs), "langid-sample")
    names = [f"c{j}" for j in range(ORDER)]
    schema = "lang string, " + "".join(f"{c} int, " for c in names) + "n long"
    part = chosen.where("NOT calibrates").select("lang", "text")
    grams = part.mapInArrow(_count_grams, schema).groupBy("lang", *names).agg(F.sum("n").alias("n")).toPandas()
    grams = grams.sort_values(["lang", *names])
    counts = {x: (g[names].to_numpy(np.uint32), g["n"].to_numpy()) for x, g in grams.groupby("lang")}
    if not counts:
        return Model([], {}, {}, np.zeros(0))
    langs = sorted(counts)
    model = fit(langs, counts)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ce, top, n, found = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ce.tolist(), type=pa.list_(pa.float64())), pa.array(top), pa.array(np.where(found, n, 0))], names=["lang", "ce", "top", "n"])

    held = chosen.where("calibrates").select("lang", "text").mapInArrow(scored, "lang string, ce array<double>, top double, n long").where("n > 0").toPandas()
    held = held[held["lang"].isin(langs)]
    truth = np.array([langs.index(x) for x in held["lang"]], dtype=np.int64)
    return calibrate(model, truth, np.array(held["ce"].tolist()).reshape(len(truth), len(langs)), held["top"].to_numpy(), held["n"].to_numpy())


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for every row of ``docs``.

    The language with the lowest cross-entropy for each character of the whole
    text wins; score is its calibrated share in [0, 1]; accepted is false if
    the cross-entropy is beyond what calibration texts of that language show.
    A text that is null or has no letter is ``und`` with score 0, not accepted;
    so is every text if there is no labelled row to learn from. Of languages
    with one cross-entropy the first by name wins. A very long text is scored
    whole, in pieces of bounded size. Null doc_ids are in the fold of the empty
    string. Repeated rows are each predicted; an empty table gives no rows.
    lang is read for training only; other columns, whatever their names, are
    not read.
    """
    shared = _shared_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, accepted = shared.value.decide([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, type=pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns.

    Null and empty texts and those without a letter go, and so do all rows if
    none is labelled; a null doc_id or lang is no reason to go. Very long texts
    are scored whole; repeated rows share their fate; an empty table stays
    empty; columns of any name pass through.
    """
    shared = _shared_model(docs, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.decide([t or "" for t in b.column(at).to_pylist()])[2]))

    return docs.mapInArrow(run, docs.schema)


def _shared_model(docs: DataFrame, model: Model | None):
    spark = docs.sparkSession
    model = model or train(docs)
    ship_package(spark)
    bounded_batches(spark)
    return spark.sparkContext.broadcast(model)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
