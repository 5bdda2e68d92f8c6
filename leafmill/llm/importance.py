"""Quality by importance resampling.

Two generative models over hashed n-grams are counted: of the target (labelled rows
that are of good quality and not toxic) and of the raw text (all rows). The n-grams are
runs of three bytes, hashed to BUCKETS numbers, and whether a word repeats the one
before it. A text's log weight is the sum over its n-grams of the log ratio of the
models, less ``prior`` for each n-gram, the value of the mean ratio that best parts the
labelled rows. Toxic text differs by a few words, not by its bytes, so it has a ratio of
its own: marks are words (runs of letters and digits, case aside) that labelled toxic
rows hold more often than the others by a likelihood-ratio test, and a logistic model
over the marks of the labelled rows gives the log odds that a text is not toxic. A text
with marks weighs no more than these odds. The prior parts the good rows from the others
among the labelled rows that the odds do not reject. Texts are sampled without replacement, in proportion to their weights,
by Gumbel top-k: those with the k highest sums of log weight and Gumbel noise are kept,
k being the number of texts with a weight of 1 or more.

The labelled rows that the target, the marks and the prior are fitted on are a bounded sample
(FIT_ROWS by hash of the id); raw counts, weights and the k-th highest sum cover all
rows. The k-th highest sum is found by histograms that narrow down on it.

Defined results: a null or empty text has no n-grams and weight 1; texts that tie with
the k-th are all kept; noise depends on the id, so repeated rows are kept or not
together; without labels of either kind every weight is 1 and all are kept; without
labelled toxic rows there are no marks; a null ``toxic`` counts as not toxic; an empty
table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.words import chunks, fresh, split_words, tidy
from leafmill.session import materialize

BUCKETS = 1 << 14
FIT_ROWS = 20_000
SMOOTHING = 0.5
PAIR = ("pair new", "pair repeated")
# A mark's likelihood-ratio statistic is at least this much (chi-square of one degree, p below 1e-7).
MARK_TEST = 30.0
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every byte n-gram, then (repeated, text) of every pair of words."""
    words = split_words(texts)
    data = words.data.astype(np.uint32)
    code = np.zeros(0, np.int64)
    doc = np.zeros(0, np.int64)
    if len(data) >= 3:
        mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        code = (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        inside = doc[2:] == doc[:-2]
        code, doc = code[inside], doc[:-2][inside]
    h, word_doc = words.hashes(), words.doc
    both = word_doc[1:] == word_doc[:-1]
    return code, doc, (h[1:] == h[:-1])[both].astype(np.int64), word_doc[1:][both]


@dataclass
class Model:
    """Log ratios of target to raw by bucket and by pair; ``prior`` is taken off for each n-gram."""

    ratio: np.ndarray
    pair_ratio: np.ndarray
    prior: float = 0.0
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mark_odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def marked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in ``marks``) of every text's distinct marks."""
        words = split_words(texts, BETWEEN)
        h = words.hashes(lower=True).view(np.int64)
        if not len(self.marks) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.marks, h), len(self.marks) - 1)
        hit = np.flatnonzero(self.marks[place] == h)
        both = np.unique(words.doc[hit] * len(self.marks) + place[hit])
        return both // len(self.marks), both % len(self.marks)

    def clean(self, texts: pa.Array) -> np.ndarray:
        """Log odds that each text is not toxic; infinite for texts without marks."""
        doc, place = self.marked(texts)
        odds = self.bias + np.bincount(doc, weights=self.mark_odds[place], minlength=len(texts))
        return np.where(np.bincount(doc, minlength=len(texts)) > 0, -odds, np.inf)

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log weight before the prior, number of n-grams) of each text."""
        code, doc, pair, pair_doc = grams(texts)
        n = len(texts)
        total = np.bincount(doc, weights=self.ratio[code], minlength=n) + np.bincount(pair_doc, weights=self.pair_ratio[pair], minlength=n)
        return total, np.bincount(doc, minlength=n) + np.bincount(pair_doc, minlength=n)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, fit_rows: int) -> DataFrame:
    """Documents with ``good`` and ``bad`` (toxic): true or false for the sampled labelled ones, else null."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
        .select(F.col("doc_id").alias("fit_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("toxic") != 0).alias("bad"))
    )
    return docs.join(F.broadcast(sample), docs[id_col] == F.col("fit_id"), "left")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Both models from one pass over all rows, and the prior from the labelled sample."""
    seen = _labelled(docs.select(id_col, text_col), labels, id_col, fit_rows).select(F.col(text_col).alias("text"), F.coalesce("good", F.lit(False)).alias("good"), "bad")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS + 2, np.int64), np.zeros(BUCKETS + 2, np.int64)
        for part in chunks(batches, "text"):
            code, doc, pair, pair_doc = grams(part.column("text"))
            is_good = part.column("good").to_numpy(zero_copy_only=False)
            raw += np.concatenate([np.bincount(code, minlength=BUCKETS), np.bincount(pair, minlength=2)])
            good += np.concatenate([np.bincount(code[is_good[doc]], minlength=BUCKETS), np.bincount(pair[is_good[pair_doc]], minlength=2)])
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"gram": some, "raw": raw[some], "good": good[some]})

    counts = seen.select("text", "good").mapInArrow(count, "gram long, raw long, good long").groupBy("gram").agg(F.sum("raw"), F.sum("good")).collect()
    raw, good = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
    for g, r, t in counts:
        raw[g], good[g] = r, t
    if not good.sum():
        return Model(np.zeros(BUCKETS), np.zeros(2))
    parts = []
    for at in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + 2)):
        k = at.stop - at.start
        parts.append(np.log((good[at] + SMOOTHING) / (good[at].sum() + SMOOTHING * k)) - np.log((raw[at] + SMOOTHING) / (raw[at].sum() + SMOOTHING * k)))
    model = Model(*parts)

    labelled = seen.where("bad is not null")
    model.marks = toxic_marks(labelled)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = part.column("text")
            total, n = model.weigh(texts)
            doc, place = model.marked(texts)
            marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_pydict({"mean": total / np.maximum(n, 1), "good": part.column("good"), "bad": part.column("bad"), "marks": marks})

    fitted = labelled.mapInArrow(mean, "mean double, good boolean, bad boolean, marks array<long>").collect()
    means, good, bad = (np.array([r[i] for r in fitted], kind) for i, kind in enumerate((float, bool, bool)))
    doc = np.repeat(np.arange(len(fitted)), [len(r.marks) for r in fitted])
    place = np.array([p for r in fitted for p in r.marks], np.int64)
    model.bias, model.mark_odds = toxic_odds(doc, place, bad, len(model.marks))
    score = model.bias + np.bincount(doc, weights=model.mark_odds[place], minlength=len(fitted))
    left = (np.bincount(doc, minlength=len(fitted)) == 0) | (score <= 0)
    model.prior = cut_point(means[left], good[left])
    return model


def toxic_marks(labelled: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that toxic rows hold more often than the other labelled rows."""
    sizes = {r.bad: r["count"] for r in labelled.groupBy("bad").count().collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not other:
        return np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = split_words(part.column("text"), BETWEEN)
            h, code = np.unique(words.hashes(lower=True).view(np.int64), return_inverse=True)
            if not len(h):
                continue
            held = np.unique(code * part.num_rows + words.doc)
            bad = part.column("bad").to_numpy(zero_copy_only=False)[held % part.num_rows]
            yield pa.RecordBatch.from_pydict({"word": h, "bad": np.bincount(held[bad] // part.num_rows, minlength=len(h)), "rest": np.bincount(held[~bad] // part.num_rows, minlength=len(h))})

    a, b = F.col("bad"), F.col("rest")

    def term(seen, rows, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) + F.when(rows - seen > 0, (rows - seen) * F.log((rows - seen) / (rows - expected))).otherwise(0.0)

    held = labelled.select("text", "bad").mapInArrow(count, "word long, bad long, rest long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("rest").alias("rest"))
    share = (a + b) / F.lit(float(toxic + other))
    test = 2 * (term(a, F.lit(float(toxic)), share * toxic) + term(b, F.lit(float(other)), share * other))
    rows = held.where((a * other > b * toxic) & (test >= MARK_TEST)).select("word").collect()
    return np.sort(np.array([r.word for r in rows], np.int64))


def toxic_odds(doc: np.ndarray, place: np.ndarray, bad: np.ndarray, k: int, rounds: int = 400, rate: float = 1.0, decay: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and log odds of each mark: logistic regression by Adam, so that a mark that others explain gets little."""
    w, n = np.zeros(k + 1), max(1, len(bad))
    if not k:
        return 0.0, w[1:]
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for turn in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[0] + np.bincount(doc, weights=w[1 + place], minlength=len(bad)), -30, 30)))
        g = np.concatenate([[(bad - p).sum()], np.bincount(place, weights=(bad - p)[doc], minlength=k)]) / n
        g[1:] -= decay * w[1:]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w += rate / np.sqrt(turn) * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return float(w[0]), w[1:]


def cut_point(means: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap in the means that misjudges fewest rows, good ones counting double."""
    if not len(means) or good.all():
        return float(means.min() - 1) if len(means) else 0.0
    order = np.argsort(means, kind="stable")
    means, good = means[order], good[order]
    # Cut before place i: good rows below are lost, the others from i on are kept.
    lost = np.concatenate([[0], np.cumsum(good)])
    kept = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    i = int(np.argmin(2 * lost + kept))
    if i == 0:
        return float(means[0] - 1)
    return float((means[i - 1] + means[i]) / 2) if i < len(means) else float(means[-1])


def weight_names(docs: DataFrame) -> list[str]:
    return fresh(docs.columns, "log_weight", "gumbel_key", "gumbel_noise")


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The rows with ``log_weight`` and ``gumbel_key``, its sum with the row's noise.

    Rows that have columns of these names get them under longer ones, by ``weight_names``.
    """
    names = docs.columns
    weight_name, key_name, noise_name = weight_names(docs)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 11) + F.lit(0.5)) / F.lit(2.0**53)
    noisy = docs.withColumn(noise_name, -F.log(-F.log(u)))
    schema = T.StructType([*docs.schema.fields, T.StructField(weight_name, T.DoubleType()), T.StructField(key_name, T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            total, n = model.weigh(part.column(text_col))
            weight = np.minimum(total - model.prior * n, model.clean(part.column(text_col)))
            noise = part.column(noise_name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(weight), pa.array(weight + noise)], names=schema.names)

    return noisy.mapInArrow(tidy(task), schema)


def kth_highest(values: DataFrame, column: str, k: int, few: int = 2000) -> float:
    """The k-th highest value, by histograms over ever narrower ranges."""
    if k <= 0:
        return float("inf")
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("inf")
    rows, above = values, 0
    while True:
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            return low
        bins = dict(rows.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).alias("b")).count().collect())
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        rows = rows.where(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)) == b)
        if bins[b] <= few:
            return sorted((r[0] for r in rows.select(column).collect()), reverse=True)[k - above - 1]
        low, high = rows.agg(F.min(column), F.max(column)).first()


def decide(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, seed: int = 0) -> tuple[Model, float, DataFrame]:
    """(model, least key that is kept, id and weights of every row)."""
    model = fit(docs, labels, id_col, text_col, fit_rows)
    weights = materialize(weigh(docs.select(id_col, text_col), model, id_col, text_col, seed).drop(text_col), "importance")
    k = weights.where("log_weight >= 0").count()
    return model, kth_highest(weights, "gumbel_key", k), weights


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """The rows that importance resampling keeps, with all their columns."""
    model, least, _ = decide(docs, labels, id_col, text_col, fit_rows, seed)
    weight, key, _ = weight_names(docs)
    return weigh(docs, model, id_col, text_col, seed).where(F.col(key) >= least).drop(weight, key)
