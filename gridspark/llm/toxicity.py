"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other training text counts as unlabelled, whatever its label says.  A
linear classifier over hashed words is fitted in numpy with the class-prior-corrected risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

under the logistic loss.  Where the bracket falls below zero the classifier fits the unlabelled texts better than any
true classifier could, and a step is taken against that bracket instead.  The texts to learn from are a bounded
sample; scoring covers whole texts of all rows, in one pass and without a shuffle.

A feature is a word or the beginning of one (compounds and endings share it), and its value is the share of the text's
words that have it, up to ``dense``: a long text gathers no evidence by its length alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_letters = re.compile(r"[^\W\d_]+")

#: Words whose weight a worker keeps.
KEPT = 200_000
#: Tasks that look through the sample.
SAMPLE_PARTS = 16


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` are the expected rows of each sample (at most twice as many), ``columns`` the features
    that the classifier uses at most."""

    positives: int = 2000
    unlabelled: int = 8000
    columns: int = 4096
    dense: float = 0.015
    bits: int = 20
    least_positive: int = 5
    steps: int = 300
    rate: float = 0.1
    shrink: float = 0.01
    default_prior: float = 0.1
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Weights by hashed word, those that are not zero, and the bias."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def table(self) -> dict[int, float]:
        return dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True))


def slot(word: str, bits: int) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def words_of(text: str | None) -> Counter:
    return Counter(_letters.findall((text or "").lower()))


def word_slots(word: str, bits: int) -> tuple[int, ...]:
    """Slots of a word and of its beginnings of three to six letters."""
    return slot(f"={word}", bits), *(slot(word[:n], bits) for n in range(3, min(6, len(word)) + 1))


def features(text: str | None, of: Callable[[str], tuple[int, ...]], dense: float) -> dict[int, float]:
    """Value by slot, for the slots that ``of`` gives for each word."""
    words, found = words_of(text), {}
    for word, n in words.items():
        for s in of(word):
            found[s] = found.get(s, 0) + n
    full = dense * max(1, words.total())
    return {s: min(1.0, n / full) for s, n in found.items()}


def risk_gradient(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Gradient by row of the non-negative risk, and the bracket's value. Unlabelled rows are those not ``positive``."""
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    chance = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    as_negative = np.logaddexp(0, margin)  # loss if the row were negative
    bracket = as_negative[~positive].sum() / n_unl - prior * as_negative[positive].sum() / n_pos
    negative_part = np.where(positive, -prior / n_pos, 1 / n_unl) * chance
    if bracket < 0:
        return -negative_part, float(bracket)
    return negative_part + np.where(positive, prior / n_pos * (chance - 1), 0), float(bracket)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, use: np.ndarray, prior: float, settings: Settings = Settings()) -> Model:
    """Fit by Adam over the whole sample of (places in ``use``, values); ``use`` has the slots that take part."""
    k, n = len(use), len(rows)
    bias = float(np.log(prior / (1 - prior)))
    if not k or not positive.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), bias, settings.bits)
    row = np.repeat(np.arange(n), [len(c) for c, _ in rows])
    col, value = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    value = value.astype(np.float64)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = bias
    for t in range(1, settings.steps + 1):
        margin = np.bincount(row, w[col] * value, n) + w[k]
        by_row, _ = risk_gradient(margin, positive, prior)
        g = np.append(np.bincount(col, by_row[row] * value, k), by_row.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = settings.rate * (1 - t / (settings.steps + 1))
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w[:k] = np.sign(w[:k]) * np.maximum(0, np.abs(w[:k]) - rate * settings.shrink)  # words of no use go to zero
    kept = w[:k] != 0
    return Model(use[kept], w[:k][kept], float(w[k]), settings.bits)


def score(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """Estimated chance that a text is toxic; for a text without words, that of the bias alone."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, kept = model.table(), {}

        def known(word: str) -> tuple[int, ...]:
            if (x := kept.get(word)) is None:
                if len(kept) >= KEPT:
                    kept.clear()
                x = kept[word] = tuple(s for s in word_slots(word, model.bits) if s in table)
            return x

        for texts in batches:
            margin = np.array([sum(table[s] * x for s, x in features(t, known, settings.dense).items()) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin + model.bias, -50, 50))))

    return scored(text)


def _sums(settings: Settings):
    """Sums by slot over each batch of ``positive, text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, lambda w: word_slots(w, settings.bits), settings.dense) for t in batch["text"]]
            if not any(found):
                continue
            slots_ = np.concatenate([np.fromiter(f, np.int64, len(f)) for f in found])
            share = np.concatenate([np.fromiter(f.values(), np.float64, len(f)) for f in found])
            of_pos = np.repeat(batch["positive"].to_numpy(bool), list(map(len, found)))
            slot_, place = np.unique(slots_, return_inverse=True)
            total = lambda x: np.bincount(place, x, len(slot_))  # noqa: B023, E731
            yield pd.DataFrame({"slot": slot_, "n_pos": total(of_pos.astype(float)), "sum_pos": total(share * of_pos), "sum": total(share), "sq": total(share * share)})

    return run


def select_slots(sample: DataFrame, n: int, n_pos: int, settings: Settings) -> np.ndarray:
    """The slots that take part: at least ``least_positive`` positives have them, and they are among the ``columns`` whose
    mean over the positives exceeds the sample's mean most, by standard deviations."""
    sums = sample.mapInPandas(_sums(settings), "slot long, n_pos double, sum_pos double, sum double, sq double").groupBy("slot").agg(
        *(F.sum(c).alias(c) for c in ("n_pos", "sum_pos", "sum", "sq"))).filter(F.col("n_pos") >= settings.least_positive)
    mean = F.col("sum") / n
    spread = F.sqrt(F.greatest(F.col("sq") / n - mean * mean, F.lit(1e-12)))
    gain = F.round((F.col("sum_pos") / n_pos - mean) / spread, 9)
    best = sums.withColumn("gain", gain).filter("gain > 0").orderBy(F.desc("gain"), "slot").limit(settings.columns)
    return np.sort(np.array([r[0] for r in best.select("slot").collect()], np.int64))


def packed_features(text: Column, use: np.ndarray, settings: Settings) -> Column:
    """Places in ``use`` (32-bit integers) and values (32-bit floats) of a text's features, as bytes."""

    @F.pandas_udf("places binary, shares binary")
    def found(texts: pd.Series) -> pd.DataFrame:
        place = {s: i for i, s in enumerate(use.tolist())}
        known = lambda w: [place[s] for s in word_slots(w, settings.bits) if s in place]
        all_ = [features(t, known, settings.dense) for t in texts]
        return pd.DataFrame({"places": [np.fromiter(f, np.int32, len(f)).tobytes() for f in all_],
                             "shares": [np.fromiter(f.values(), np.float32, len(f)).tobytes() for f in all_]})

    return found(text)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from the rows where ``usable`` (a column over ``docs``) holds: those labelled 1, and any as unlabelled.

    The class prior is the share of 1 among usable labels (``default_prior`` where there are none); an id with several
    labels has the greatest.  Both samples are drawn by a hash of the id, so they do not depend on partitioning.  What the
    driver gets is bounded by the samples' rows times ``columns``.
    """
    ok = docs.filter((F.lit(True) if usable is None else usable) & F.col(text_col).isNotNull())
    text = ok.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    marks = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.max(F.col(label_col).cast("int")).alias("_y")))
    known = ok.select(F.col(id_col).alias("_id")).join(marks, "_id").dropDuplicates(["_id"])  # only labelled ids are made distinct
    n_pos, n_known = known.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count("*")).first()
    n_all = ok.count()
    prior = min(0.9, max(0.001, n_pos / n_known)) if n_pos else settings.default_prior

    def drawn(most: int, n: int) -> Column:
        return F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40) <= min(1.0, most / max(1, n))

    toxic_ids = known.filter((F.col("_y") == 1) & drawn(settings.positives, n_pos)).select("_id").limit(2 * settings.positives)
    toxic = text.join(F.broadcast(toxic_ids), "_id", "left_semi").limit(2 * settings.positives).select(F.lit(True).alias("positive"), "text")
    rest = text.filter(drawn(settings.unlabelled, n_all)).limit(2 * settings.unlabelled).select(F.lit(False).alias("positive"), "text")
    sample = written(toxic.union(rest).repartition(SAMPLE_PARTS))  # at most twice the two samples
    n, n_toxic = sample.agg(F.count("*"), F.count_if("positive")).first()
    if not n_toxic:
        return fit([], np.zeros(0, bool), np.zeros(0, np.int64), prior, settings)
    use = select_slots(sample, n, n_toxic, settings)
    rows = sample.select("positive", packed_features(F.col("text"), use, settings).alias("f")).select("positive", "f.*").collect()
    return fit([(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in rows], np.array([r[0] for r in rows], bool), use, prior, settings)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, score, predicted`` for every row; ``predicted`` is 1 from the threshold on.

    NULL and empty texts get the bias's score, repeated rows one result each, an empty table an empty result; other columns
    are ignored.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model, settings).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
