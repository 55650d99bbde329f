"""Toxicity by maximum-scoring segments.

Every word has a log-odds weight, toxic against clean, under an informative Dirichlet prior;
unknown words share one small negative weight.  A linear scan finds all maximal scoring
segments of a text; extreme-value statistics turn the significant ones into one evidence
figure, which a logistic curve calibrates to a probability.
"""

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairwright.llm.shared import fold, landed

WORD = re.compile(r"[^\W_]+")
SAMPLE_ROWS = 16_384  # bound of the labelled sample
PRIOR = 2.0  # pseudo-uses of a word on average
LIKELIHOOD = 20.0  # likelihood-ratio statistic from which a word has a weight of its own
MOST = 6.0  # weights are held within
SIGNIFICANT = 0.05  # chance of a segment as good in a clean text
FOLDS = 5


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    other: float  # weight of every other word
    lam: float  # decay of the segment scores in clean texts
    k: float
    slope: float
    bias: float

    def _floor(self, n: int) -> float:
        """Log of the expected number of chance segments of score 0."""
        return math.log(max(self.k * n, 1e-300))

    def segments(self, found: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, score) of the significant maximal segments, in word positions."""
        scored = [(i, w) for i, w in enumerate(map(self.weights.get, found)) if w is not None]
        least = (self._floor(len(found)) - math.log(-math.log1p(-SIGNIFICANT))) / self.lam
        return [s for s in maximal_segments(scored, self.other, len(found)) if s[2] >= least]

    def probability(self, n: int, scores: list[float]) -> float:
        """Of a text of ``n`` words with significant segments of these scores."""
        return 1 / (1 + math.exp(-(self.slope * self.evidence(n, scores) + self.bias)))

    def evidence(self, n: int, scores: list[float]) -> float:
        """Summed surprise of the segments, on a log scale; 0 without any."""
        return math.log1p(sum(max(0.0, self.lam * s - self._floor(n)) for s in scores))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def maximal_segments(scored: list[tuple[int, float]], other: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa, 1999) of ``n`` words, in time linear in the scored words.

    ``scored`` lists the words with weights of their own; the words between them weigh
    ``other`` < 0, so no segment begins or ends with them.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to the end, link
    # the link of a segment is the nearest kept one before it with a smaller sum before; what
    # lies between has none, so no search passes it again
    total, last = 0.0, -1
    for i, w in scored:
        total += other * (i - last - 1)
        last = i
        if w <= 0:
            total += w
            continue
        start, left = i, total
        total += w
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, i + 1, left, total, j))
                break
            start, _, left, _, link = kept[j]
            del kept[j:]
            j = link
    return [(s, e, right - left) for s, e, left, right, _ in kept]


def _log_odds(counts: pd.DataFrame) -> pd.DataFrame:
    """counts: word, toxic, clean -> weight of each word whose use differs significantly between the labels."""
    toxic, clean = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    share = toxic.sum() / (toxic.sum() + clean.sum())
    # the prior is the words' common distribution, PRIOR pseudo-uses a word on average
    prior = PRIOR * (toxic + clean) / (toxic + clean).mean()
    a, b = toxic + prior * share, clean + prior * (1 - share)
    delta = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.nan_to_num(toxic * np.log(toxic / ((toxic + clean) * share))) + np.nan_to_num(clean * np.log(clean / ((toxic + clean) * (1 - share)))))
    return pd.DataFrame({"word": counts["word"], "weight": delta.clip(-MOST, MOST), "clean": clean})[g >= LIKELIHOOD]


def _decay(weights: np.ndarray, chance: np.ndarray, other: float) -> float:
    """The positive root of sum(chance * exp(lambda * weight)) = 1 in clean text."""
    rest = max(1e-9, 1 - chance.sum())
    grow = lambda x: (chance * np.exp(x * weights)).sum() + rest * math.exp(x * other) - 1
    high = 0.25
    while grow(high) < 0 and high < 64:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 0 else (low, mid)
    return max(high, 0.05)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(``text``, ``toxic``, ``weight``, ``calibration``) of at most ``rows`` labelled documents outside the held-out fold, half of either label where there are enough.

    ``weight`` restores the share of the labels, ``calibration`` marks the third that the word
    weights are not learned from.  The chosen label rows number at most ``rows``, so they are
    broadcast to the documents.
    """
    known = labels.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id", F.lit("toxicity"))
    weight = known.groupBy(F.col("toxic").alias("t")).agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / (rows // 2)).alias("weight"))
    half = [known.where(F.col("toxic") == t).orderBy(place, "doc_id").limit(rows // 2) for t in (0, 1)]
    part = (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0).alias("calibration")
    chosen = half[0].union(half[1]).join(F.broadcast(weight), F.col("toxic") == F.col("t")).select("doc_id", "toxic", "weight", part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight", "calibration")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn word weights, segment statistics and the calibration; without both labels every text scores the base rate."""
    spark_words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    sample = landed(labelled_sample(docs, labels, rows), "toxicity-sample")  # read three times
    # words of one document only say nothing; the rest is bounded by the sample
    counted = (
        sample.where("NOT calibration").select("toxic", F.explode(F.array_distinct(spark_words)).alias("word")).groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )
    total = counted.where("toxic + clean > 1").toPandas().astype({"toxic": float, "clean": float}).sort_values("word")
    base = sample.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("toxic")).alias("toxic")).first()
    n_toxic, n_clean = base.toxic or 0.0, (base.n or 0.0) - (base.toxic or 0.0)
    if not n_toxic or not n_clean or not len(total):
        share = n_toxic / base.n if base.n else 0.0
        return ToxicityModel({}, -1.0, 1.0, 1.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    weighed = _log_odds(total)
    weights = dict(zip(weighed["word"], weighed["weight"].astype(float), strict=True))
    chance = weighed["clean"].to_numpy() / max(1.0, total["clean"].sum())
    other = -0.25
    lam = _decay(weighed["weight"].to_numpy(), chance, other)

    def best(batches):
        for b in batches:
            found = [words(t) for t in b["text"]]
            segments = [maximal_segments([(i, w) for i, w in enumerate(map(weights.get, f)) if w is not None], other, len(f)) for f in found]
            yield pd.DataFrame({"toxic": b["toxic"], "weight": b["weight"], "n": [len(f) for f in found], "best": [max((s for *_, s in own), default=0.0) for own in segments], "sums": [[s for *_, s in own] for own in segments]})

    seen = sample.where("calibration").mapInPandas(best, "toxic int, weight double, n long, best double, sums array<double>").toPandas()
    clean = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    # Gumbel location of lambda * best - log n in clean texts
    location = float(np.mean(lam * clean["best"] - np.log(clean["n"]))) - 0.5772 if len(clean) else 0.0
    k = math.exp(location)
    shape = ToxicityModel(weights, other, lam, k, 1.0, 0.0)
    least = -math.log(-math.log1p(-SIGNIFICANT))
    evidence = np.array([shape.evidence(n, [s for s in sums if lam * s >= shape._floor(n) + least]) for n, sums in zip(seen["n"], seen["sums"], strict=True)])
    slope, bias = _logistic(evidence, seen["toxic"].to_numpy(float), seen["weight"].to_numpy(float))
    return ToxicityModel(weights, other, lam, k, slope, bias)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps on slope and bias with a small ridge; the slope is never negative."""
    slope, bias = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + bias).clip(-30, 30)))
        w = weight * (p * (1 - p) + 1e-9)
        grad = np.array([(weight * (y - p) * x).sum() - 1e-2 * slope, (weight * (y - p)).sum() - 1e-2 * bias])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hess, grad).clip(-2, 2)
        slope, bias = slope + move[0], bias + move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(0.0, float(slope)), float(bias)


def score_toxicity(model: ToxicityModel, text: Column) -> Column:
    """struct(score, predicted, passages) of each whole text; passages are (first_word, end_word, weight).

    A null or empty text has no passages and the score of no evidence.
    """

    @F.pandas_udf("score double, predicted int, passages array<struct<first_word:long,end_word:long,weight:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = words(text)
            segments = model.segments(found)
            score = model.probability(len(found), [s for *_, s in segments])
            rows.append((score, int(score >= 0.5), [{"first_word": a, "end_word": b, "weight": s} for a, b, s in segments]))
        return pd.DataFrame(rows, columns=["score", "predicted", "passages"])

    return judge(text)
