"""Search of quality criteria on labelled pairs, and method scores under the chosen one.

Texts are reduced to their counts once per pair; only numbers meet the weight grid.  A batch
of pairs becomes one matrix of margins, of which each task sends a few sums and counts per
weight vector and batch: what is shuffled does not hold a row per pair.
"""

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairwright import fixed_values as fixed
from pairwright.functions.text import metric_columns
from pairwright.functions.values import criterion_score, number_or_zero, style_noise
from pairwright.operators.joins import keyed_join, last_by_key
from pairwright.operators.quantiles import STEP, middle_keys, stats_with_median
from pairwright.operators.requests import column_or
from pairwright.session import landed

WEIGHTS = ["repeated_penalty", "length_penalty_per_100_words", "abnormal_penalty"]
TOLERANCE = 0.002
COUNTS = ["repeated_line_count", "word_count", "abnormal_symbol_count", "code_fence_mismatch", "slogan_phrase_count"]


def weight_grid(
    repeated: list[float] = fixed.REPEATED_PENALTIES,
    length: list[float] = fixed.LENGTH_PENALTIES,
    abnormal: list[float] = fixed.ABNORMAL_PENALTIES,
) -> list[tuple[float, float, float]]:
    return list(product(repeated, length, abnormal))


def _features(side: str):
    m = metric_columns(F.col(f"{side}_text"))
    return [
        F.col(f"{side}_score").cast("double").alias(f"{side}_score"),
        m["repeated_line_count"].cast("double").alias(f"{side}_repeats"),
        m["word_count"].cast("double").alias(f"{side}_words"),
        style_noise(m).cast("double").alias(f"{side}_noise"),
    ]


def _margins(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The margins of a batch under each weight vector; pairs without a score have none."""
    side = lambda name: tuple(batch[f"{name}_{c}"].to_numpy(zero_copy_only=False).astype(float) for c in ("score", "repeats", "words", "noise"))
    chosen, rejected = side("chosen"), side("rejected")
    known = _known(batch)
    for i, (repeat, length, noise) in enumerate(weights):
        # in the order of criterion_score, so that both round alike
        of = lambda x: x[0] - repeat * x[1] - length * x[2] / 100.0 - noise * x[3]
        yield i, (of(chosen) - of(rejected))[known]


def _known(batch: pa.RecordBatch) -> np.ndarray:
    return np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])


def _keys(values: np.ndarray) -> np.ndarray:
    """Order keys as quantiles.order_key has them."""
    size = np.abs(values).view(np.int64)
    return np.where(np.isnan(values), np.int64((1 << 63) - 1), np.where(values < 0, -size, size))


def _folded(weights: np.ndarray, fold: Callable[[int, np.ndarray], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]):
    """Rows (grid_order, …) that ``fold`` makes of the margins of each batch and weight vector."""

    def run(batches):
        for batch in batches:
            rows = [(i, *row) for i, margins in _margins(batch, weights) if len(margins) for row in fold(i, margins)]
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), *kinds], strict=True)], names=["grid_order", *names])

    return run


def _measured(weights: np.ndarray):
    fold = lambda _, m: [(len(m), int((m > 0).sum()), float(m.sum()), float(m.min()))]
    return _folded(weights, fold, ["n", "better", "total", "least"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()])


def _bucketed(weights: np.ndarray, opened: dict[int, int] | None, shift: int):
    def fold(i, margins):
        key = _keys(margins)
        if opened is not None:
            key = key[key >> (shift + STEP) == opened[i]] if i in opened else key[:0]
        return zip(*(x.tolist() for x in np.unique(key >> shift, return_counts=True)), strict=True)

    return _folded(weights, fold, ["bucket", "n"], [pa.int64(), pa.int64()])


def _around(weights: np.ndarray, middle: dict[int, int]):
    """How many margins come up to the middle one, its value, and the next larger."""

    def fold(i, margins):
        key = _keys(margins)
        at, above = margins[key == middle[i]], margins[key > middle[i]]
        return [(len(key), int((key <= middle[i]).sum()), float(at[0]) if len(at) else None, float(above.min()) if len(above) else None)]

    return _folded(weights, fold, ["n", "upto", "low", "next"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()])


def search_criteria(pairs: DataFrame, grid: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """Accuracy and mean, median and minimum margin of every weight vector, best first.

    ``pairs`` holds chosen_text, rejected_text, chosen_score and rejected_score.
    """
    grid = weight_grid() if grid is None else grid
    weights = np.array(grid, float).reshape(-1, len(WEIGHTS))
    # eight numbers per pair, read once a pass
    features = landed(pairs.select(*_features("chosen"), *_features("rejected")), "criterion-features")
    partial = features.mapInArrow(_measured(weights), "grid_order int, n long, better long, total double, least double")
    measured = partial.groupBy("grid_order").agg(
        F.sum("n").alias("n"), (F.sum("better") / F.sum("n")).alias("pairwise_accuracy"), (F.sum("total") / F.sum("n")).alias("mean_margin"), F.min("least").alias("min_margin")
    )

    def histogram(opened: DataFrame | None, shift: int) -> DataFrame:
        kind = "grid_order int, bucket long, n long"
        if opened is None:
            counts = features.mapInArrow(_bucketed(weights, None, shift), kind)
        else:  # a row per weight vector
            prefixes = {r.grid_order: r.prefix for r in opened.collect()}
            counts = features.mapInArrow(_bucketed(weights, prefixes, shift), kind)
        return counts.groupBy("grid_order", "bucket").agg(F.sum("n").alias("n"))

    middle = {r.grid_order: r.middle for r in middle_keys(histogram, ["grid_order"]).collect()}
    around = features.mapInArrow(_around(weights, middle), "grid_order int, n long, upto long, low double, next double")
    around = around.groupBy("grid_order").agg(F.sum("n").alias("n"), F.sum("upto").alias("upto"), F.max("low").alias("low"), F.min("next").alias("next"))
    high = F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("low")).otherwise(F.col("next"))
    median = around.select("grid_order", ((F.col("low") + high) / 2).alias("median_margin"))
    named = features.sparkSession.createDataFrame([(i, *map(float, w)) for i, w in enumerate(grid)], f"grid_order int, {', '.join(f'{n} double' for n in WEIGHTS)}")
    return named.join(measured, "grid_order").join(median, "grid_order").select("grid_order", *WEIGHTS, "pairwise_accuracy", "mean_margin", "median_margin", "min_margin")


def ranked_criteria(searched: DataFrame, n: int | None = None) -> DataFrame:
    """Weight vectors by accuracy, then mean margin, best first; ties keep grid order."""
    ordered = searched.orderBy(
        F.desc("pairwise_accuracy"), F.round("mean_margin", 9).desc(), F.asc("grid_order")
    )
    return ordered if n is None else ordered.limit(n)


def choose_criterion(searched: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The weight vector to use: near-best accuracy, then mean margin, then the smallest penalties.

    Means are compared at nine digits, so that the order of summation cannot decide a tie.
    """
    best = searched.agg(F.max("pairwise_accuracy").alias("best")).scalar()
    return (
        searched.where(F.col("pairwise_accuracy") >= best - F.lit(tolerance))
        .orderBy(
            F.round("mean_margin", 9).desc(),
            F.round(sum((F.col(n) for n in WEIGHTS[1:]), F.col(WEIGHTS[0])), 9).asc(),
            F.desc("pairwise_accuracy"),
            F.asc("grid_order"),
        )
        .limit(1)
    )


def score_methods(outputs: DataFrame, scores: DataFrame, criterion: DataFrame, order: str = "seq") -> DataFrame:
    """Method table under the chosen criterion, best mean first.

    Every output needs a score for its prompt and method; a missing one is an error.
    """
    chosen = criterion.select(F.struct(*WEIGHTS).alias("c")).scalar()
    latest = last_by_key(scores.select("prompt_id", "method", F.col("score").cast("double").alias("score"), order), ["prompt_id", "method"], order)
    metrics = metric_columns(column_or(outputs, "final_answer", ""))
    measured = outputs.select(
        "prompt_id",
        "method",
        *(metrics[c].alias(c) for c in COUNTS),
        number_or_zero(outputs, "latency_ms").alias("latency_ms"),
        number_or_zero(outputs, "verifier_call_count").alias("verifier_call_count"),
    )
    joined = (
        keyed_join(measured, latest.select("prompt_id", "method", "score"), ["prompt_id", "method"], "left")
        .withColumn("score", F.coalesce("score", F.raise_error(F.lit("output without a score")).cast("double")))
        .withColumn("c", chosen)
    )
    rows = joined.select(
        "method",
        "score",
        criterion_score(
            F.col("score"), F.col("repeated_line_count"), F.col("word_count"),
            style_noise({c: F.col(c) for c in COUNTS}),
            *(F.col(f"c.{n}") for n in WEIGHTS),
        ).alias("criterion_score"),
        *COUNTS,
        "latency_ms",
        "verifier_call_count",
    )
    return stats_with_median(
        rows,
        ["method"],
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("criterion_score").alias("criterion_score_mean"),
            F.avg("score").alias("verifier_score_mean"),
            F.sum("repeated_line_count").alias("repeated_line_total"),
            F.avg("word_count").alias("word_count_mean"),
            F.sum("abnormal_symbol_count").alias("abnormal_symbol_total"),
            F.sum("code_fence_mismatch").alias("code_fence_mismatch_total"),
            F.sum("slogan_phrase_count").alias("slogan_phrase_total"),
            F.avg("latency_ms").alias("latency_ms_mean"),
            F.avg("verifier_call_count").alias("verifier_call_count_mean"),
        ],
        "criterion_score",
        "criterion_score_median",
    ).orderBy(F.desc("criterion_score_mean"))
