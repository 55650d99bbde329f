"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the histogram of its hashed letter 1- to 3-grams (with word boundaries); the
model averages their embeddings and applies a linear softmax.  It is trained by stochastic
gradient descent in numpy on a bounded sample of labelled texts, its temperature and its
rejection threshold are calibrated on a part of the sample that the training never sees.
"""

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.llm.shared import landed

BUCKETS, DIM = 4096, 16
SAMPLE_ROWS = 4096  # bound of the labelled sample, shared evenly among the languages
LEAST_TEXTS = 16  # of a language, however many there are
EPOCHS, BATCH, RATE = 12, 64, 2.0
CHUNK = 1 << 20  # letters handled at once in a long text
UNKNOWN = "und"
REJECTED_RIGHT = 0.001  # share of rightly named calibration texts that the threshold may reject


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for everything else."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def histogram(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of the hashed subwords of the whole text; None without a letter."""
    if not text:
        return None
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not points.any():
        return None
    counts = np.zeros(buckets, np.int64)
    for start in range(0, len(points), CHUNK):  # two code points of overlap carry the n-grams across
        c = np.concatenate([np.zeros(2 if start == 0 else 0, np.uint32), points[max(0, start - 2) : start + CHUNK], np.zeros(1 if start + CHUNK >= len(points) else 0, np.uint32)])
        c = c * np.uint32(2654435761)
        two = (c[1:] ^ (c[:-1] * np.uint32(31))) * np.uint32(2246822519)
        three = (two[1:] ^ (c[:-2] * np.uint32(131071))) * np.uint32(3266489917)
        live = c[2:] != 0  # n-grams that end in a letter, or at a word's end
        shift = np.uint32(32 - buckets.bit_length() + 1)
        for gram, keep in ((c[2:], live), (two[1:], live | (c[1:-1] != 0)), (three, live | (c[1:-1] != 0))):
            counts += np.bincount(gram[keep] >> shift, minlength=buckets)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    embedding: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x labels
    temperature: float
    threshold: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Rows of histograms to calibrated probabilities."""
        mean = counts / counts.sum(axis=1, keepdims=True)
        return _softmax(mean @ self.embedding @ self.weights / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = histogram(text, len(self.embedding)) if self.labels else None
        if counts is None:
            return UNKNOWN, 0.0
        p = self.probabilities(counts[None])[0]
        return self.labels[int(p.argmax())], float(p.max())


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, truth: np.ndarray, labels: tuple[str, ...], calibration: np.ndarray, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on the rows outside ``calibration`` (a mask).  ``counts`` is overwritten."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (counts.shape[1], DIM))
    weights = rng.normal(0, 0.1, (DIM, len(labels)))
    counts /= counts.sum(axis=1, keepdims=True)
    mean = counts
    rows = np.flatnonzero(~calibration)
    share = np.bincount(truth[rows], minlength=len(labels)).clip(1)
    balance = (len(rows) / len(labels) / share)[truth]  # rare languages weigh as much as common ones
    steps = EPOCHS * max(1, -(-len(rows) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(rows), max(1, -(-len(rows) // BATCH))):
            x = mean[batch]
            hidden = x @ embedding
            error = (_softmax(hidden @ weights) - np.eye(len(labels))[truth[batch]]) * balance[batch, None].clip(max=10) / max(1, len(batch))
            rate = RATE * (1 - step / steps)
            grad = error @ weights.T
            weights -= rate * (hidden.T @ error)
            embedding -= rate * 10 * (x.T @ grad)  # a bucket holds a small share of a text
            step += 1
    check = np.flatnonzero(calibration) if calibration.any() else rows
    logits = mean[check] @ embedding @ weights
    at = (np.arange(len(check)), truth[check])
    grid = np.geomspace(0.05, 20, 61)
    temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[at].clip(1e-12)).mean()))
    p = _softmax(logits / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth[check]])
    # a conformal quantile, never above an even chance: doubtful texts go, surely named ones stay
    quantile = right[int(REJECTED_RIGHT * len(right))] if len(right) else 0.5
    return LanguageModel(labels, embedding, weights, temperature, float(min(0.5, quantile)))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Distinct labelled texts with a letter, the same number of each language (all if it has fewer), chosen by a hash of the text.

    ``rows`` are shared out, but a language gets ``LEAST_TEXTS`` at least; copies of a text
    count once.  Only ``text`` and ``lang`` are read.
    """
    h = F.xxhash64("text", F.lit("sample"))
    known = docs.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("text", "lang", h.alias("h"))
    distinct = landed(known.select("lang", "h").distinct(), "language-texts")
    n = distinct.groupBy("lang").count()
    per = F.greatest(F.ceil(F.lit(rows) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))), F.lit(LEAST_TEXTS))
    unit = (F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).alias("unit")
    # twice the share and some more lie below the rate, so the ranks are taken over few rows
    shares = n.select("lang", per.alias("per"), ((2 * per + 64) / F.col("count")).alias("rate"))
    near = distinct.join(F.broadcast(shares), "lang").select("lang", "h", "per", unit, "rate").where("unit < rate")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "h"))
    chosen = near.withColumn("place", place).where("place <= per").select("lang", "h", "unit")
    return known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h", "unit").agg(F.min("text").alias("text")).select("text", "lang", "unit")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from the labelled rows of ``docs``; without any, a model that names every text ``und``."""

    def features(batches):
        for b in batches:
            found = [histogram(t) for t in b["text"]]
            keep = [i for i, h in enumerate(found) if h is not None]
            yield pd.DataFrame({
                "lang": b["lang"].iloc[keep].to_list(), "unit": b["unit"].iloc[keep].to_list(),
                "at": [np.flatnonzero(found[i]).astype("<u2").tobytes() for i in keep],
                "n": [found[i][found[i] > 0].clip(max=2**31 - 1).astype("<u4").tobytes() for i in keep],
            })

    got = labelled_sample(docs, rows).mapInPandas(features, "lang string, unit double, at binary, n binary").orderBy("unit", "lang", "at", "n").toArrow()
    named = got["lang"].to_pylist()
    labels = tuple(sorted(set(named)))
    if not labels:
        return LanguageModel((), np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), 1.0, 0.5)
    # the one large table on the driver: bounded by the sample, in single precision
    counts = np.zeros((len(named), BUCKETS), np.float32)
    for row, at, n in zip(counts, got["at"], got["n"], strict=True):
        row[np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(n.as_buffer(), "<u4")
    del got
    truth = np.array([labels.index(lang) for lang in named])
    # every fourth text of a language; one with fewer is only learned from
    nth = pd.Series(named).groupby(named).cumcount().to_numpy()
    calibration = nth % 4 == 3 if len(named) >= 40 else np.zeros(len(named), bool)
    return train(counts, truth, labels, calibration)


def identify(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, accepted) of each whole text.

    ``und`` with score 0 and not accepted for a null text or one without a letter; else the
    likeliest learned language with its calibrated probability, accepted from the model's
    threshold on.
    """

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def name(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(t) for t in texts]
        langs, scores = [f[0] for f in found], [f[1] for f in found]
        return pd.DataFrame({"lang_pred": langs, "score": scores, "accepted": [lang != UNKNOWN and s >= model.threshold for lang, s in found]})

    return name(text)
