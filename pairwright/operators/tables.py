"""Per-method tables over the method-output fact table.

Every table is one hash aggregation with map-side combine; texts are reduced to numbers
in the scan stage and are never shuffled.  Pass a table that already carries the metric
columns (see :func:`with_metrics`) to reuse the numbers for several tables.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pairwright.functions import text as T
from pairwright.functions.values import compute_budget, is_yes, number_or_zero, parsed_or_zero
from pairwright.operators.joins import winners
from pairwright.operators.requests import answer_of, column_or, static_answer_of

HUMAN_FLAGS = [
    "ttc_removes_visible_defects",
    "ttc_loses_useful_information",
    "verifier_over_penalizes_valid_wording",
]


def with_metrics(outputs: DataFrame, answer: Column | None = None) -> DataFrame:
    """Add the metrics of the answer text as columns; those a query does not read are pruned."""
    if set(T.METRICS) <= set(outputs.columns):
        return outputs
    return outputs.withColumns(T.metric_columns(answer_of(outputs) if answer is None else answer))


def method_numbers(outputs: DataFrame) -> DataFrame:
    """Method, cost and metric columns of the outputs without the texts; persist it to build several tables."""
    cost = [c for c in ("latency_ms", "verifier_call_count") if c in outputs.columns]
    return with_metrics(outputs).select(column_or(outputs, "method", "unknown").alias("method"), *cost, *T.METRICS)


def _by_method(df: DataFrame):
    return df.withColumn("method", column_or(df, "method", "unknown")).groupBy("method")


def static_metrics(outputs: DataFrame) -> DataFrame:
    """Per-row metrics of the static evaluation (prefers ``answer`` over ``final_answer``)."""
    df = outputs.withColumn("metrics", T.text_metrics(static_answer_of(outputs)))
    return df.select(column_or(df, "prompt_id", "").alias("prompt_id"), column_or(df, "method", "unknown").alias("method"), "metrics")


def summarize_metrics(rows: DataFrame, names: list[str] = T.METRICS) -> DataFrame:
    """Row count and mean of each metric by method; absent values do not enter a mean.

    The metrics are fields of a ``metrics`` struct, or columns.
    """
    nested = "metrics" in rows.columns
    return _by_method(rows).agg(
        F.count(F.lit(1)).alias("count"),
        *(F.avg(F.col("metrics")[name] if nested else F.col(name)).alias(f"{name}_mean") for name in sorted(names)),
    )


def summarize_metric_map(rows: DataFrame) -> DataFrame:
    """Same for metrics kept as a map with varying keys: one row per method and key.

    The row counts come from a key-less entry, so both are one aggregation.
    """
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))),
        F.transform(F.map_entries("metrics"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value"))),
    )
    cells = rows.select(column_or(rows, "method", "unknown").alias("method"), F.explode(entries).alias("e"))
    return cells.groupBy("method", F.coalesce("e.key", F.lit("count")).alias("name")).agg(
        F.when(F.count("e.key") == 0, F.count(F.lit(1)).cast("double")).otherwise(F.avg("e.value")).alias("value")
    )


def overall_table(outputs: DataFrame) -> DataFrame:
    names = ["abnormal_symbol_count", "code_fence_mismatch", "slogan_phrase_count", "word_count"]
    return (
        _by_method(with_metrics(outputs))
        .agg(F.count(F.lit(1)).alias("count"), *(F.avg(n).alias(f"{n}_mean") for n in names))
        .orderBy("method")
    )


def error_breakdown(outputs: DataFrame) -> DataFrame:
    names = ["abnormal_symbol_count", "code_fence_mismatch", "slogan_phrase_count", "repeated_line_count"]
    return (
        _by_method(with_metrics(outputs))
        .agg(*(F.sum(n).alias(f"{n}_total") for n in names))
        .orderBy("method")
    )


def latency_table(outputs: DataFrame) -> DataFrame:
    """Means over all rows; a missing or non-numeric value counts as 0."""
    return (
        _by_method(outputs)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(number_or_zero(outputs, "latency_ms")).alias("latency_ms_mean"),
            F.avg(number_or_zero(outputs, "verifier_call_count")).alias("verifier_call_count_mean"),
        )
        .orderBy("method")
    )


def quality_vs_compute(outputs: DataFrame) -> DataFrame:
    """Mean score, verifier calls and latency by method and compute budget."""
    budget = compute_budget(F.col("decoding_parameters")) if "decoding_parameters" in outputs.columns else F.lit("default")
    names = ["final_score", "verifier_call_count", "latency_ms"]
    return (
        outputs.groupBy(column_or(outputs, "method", "unknown").alias("method"), budget.alias("compute_budget"))
        .agg(F.count(F.lit(1)).alias("count"), *(F.avg(parsed_or_zero(outputs, n)).alias(f"{n}_mean") for n in names))
        .orderBy("method", "compute_budget")
    )


def human_review_sheet(outputs: DataFrame, methods: list[str], order: str = "seq") -> DataFrame:
    """One row per prompt: first prompt text, last answer of each method, blank columns for the votes.

    The rows to show are found by their numbers; their texts meet at the prompt id in the end.
    """
    rows = outputs.select(
        column_or(outputs, "prompt_id", "").alias("prompt_id"), column_or(outputs, "method", "unknown").alias("method"), column_or(outputs, "prompt", "").alias("prompt"), answer_of(outputs).alias("answer"), F.col(order)
    )
    blank = ["best_method", *HUMAN_FLAGS, "notes"]
    sheet = winners(rows.select("prompt_id", "prompt", order), ["prompt_id"], order, largest=False).select("prompt_id", "prompt")
    last = winners(rows.where(F.col("method").isin(methods)).drop("prompt"), ["prompt_id", "method"], order)
    for m in methods:
        sheet = sheet.join(last.where(F.col("method") == m).select("prompt_id", F.col("answer").alias(f"{m}_answer")), "prompt_id", "left")
    return sheet.select("prompt_id", "prompt", *(F.lit("").alias(c) for c in blank), *(f"{m}_answer" for m in methods))


def human_preference_table(reviews: DataFrame) -> DataFrame:
    """Votes and vote rate per method, with the yes counts and rates of all reviewed rows on each line."""
    best = T.strip(F.coalesce(F.col("best_method"), F.lit("")))
    per_method = (
        reviews.where(best != "")
        .groupBy(best.alias("method"))
        .agg(
            F.count(F.lit(1)).alias("best_count"),
            *(F.count_if(is_yes(F.col(flag))).alias(flag) for flag in HUMAN_FLAGS),
        )
    )
    totals = per_method.agg(
        F.struct(F.sum("best_count").alias("n"), *(F.sum(flag).alias(flag) for flag in HUMAN_FLAGS)).alias("t")
    ).scalar()
    columns = []
    for flag in HUMAN_FLAGS:
        columns += [
            F.col("t")[flag].alias(f"{flag}_yes_count"),
            (F.col("t")[flag] / F.col("t.n")).alias(f"{flag}_yes_rate"),
        ]
    return (
        per_method.withColumn("t", totals)
        .select(
            "method",
            F.col("t.n").alias("reviewed_count"),
            "best_count",
            (F.col("best_count") / F.col("t.n")).alias("preference_rate"),
            *columns,
        )
        .orderBy("method")
    )


def join_metric_tables(*tables: DataFrame) -> DataFrame:
    """Full outer join of per-method tables; a later table's value replaces an earlier one's."""

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns and c != "method"]
        renamed = right.withColumnsRenamed({c: f"_{c}" for c in shared})
        joined = left.join(renamed, "method", "full_outer")
        return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in shared}).drop(*(f"_{c}" for c in shared))

    return reduce(both, tables)


def results_table(metrics: DataFrame, method_scores: DataFrame, summary: DataFrame, methods: list[str]) -> DataFrame:
    """Main results of the listed methods, in list order."""
    order = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    listed = F.col("method").isin(methods)
    return (
        metrics.where(listed)
        .select("method", "repeated_line_count_total", "word_count_mean", "latency_ms_mean", "verifier_call_count_mean")
        .join(
            method_scores.where(listed).select(
                "method",
                F.col("criterion_score_mean").alias("quality_mean"),
                F.col("criterion_score_median").alias("quality_median"),
            ),
            "method",
        )
        .join(summary.where(listed).select("method", F.col("mean").alias("verifier_mean")), "method")
        .select(
            order.alias("position"),
            "method",
            "quality_mean",
            "quality_median",
            "verifier_mean",
            F.col("repeated_line_count_total").alias("repeated_line_total"),
            "word_count_mean",
            "latency_ms_mean",
            "verifier_call_count_mean",
        )
        .orderBy("position")
    )


def side_effects(metrics: DataFrame, summary: DataFrame, base: str, candidate: str) -> DataFrame:
    """One row: relative drop of repeated lines and drop of the mean score from ``base`` to ``candidate``."""

    def of(method: str, column: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(column)))

    joined = metrics.join(summary, "method")
    repeats = "repeated_line_count_total"
    return joined.agg(
        of(base, repeats).alias("base_repeated_lines"),
        of(candidate, repeats).alias("candidate_repeated_lines"),
        F.try_divide(of(base, repeats) - of(candidate, repeats), of(base, repeats)).alias("repeated_line_drop"),
        of(base, "word_count_mean").alias("base_words"),
        of(candidate, "word_count_mean").alias("candidate_words"),
        (of(base, "mean") - of(candidate, "mean")).alias("score_drop"),
    )


def improvement_gate(
    method_scores: DataFrame,
    pairwise: DataFrame,
    complete: Column,
    candidate: str,
    baselines: list[str],
    min_win_rate: float = 0.7,
) -> DataFrame:
    """One row of yes/no checks: is the candidate a real improvement over all baselines?

    ``method_scores`` is the criterion table, ``pairwise`` the win/loss table of the candidate,
    ``complete`` a boolean column or scalar from the completeness report.
    """
    is_candidate, is_base = F.col("method") == candidate, F.col("method").isin(baselines)
    noise = F.col("abnormal_symbol_total") + F.col("code_fence_mismatch_total") + F.col("slogan_phrase_total")
    quality = F.col("criterion_score_mean")
    wins = (
        pairwise.where(F.col("reference").isin(baselines))
        .agg((F.count_if(F.col("win_rate") > F.lit(min_win_rate)) == len(baselines)).alias("ok"))
        .scalar()
    )
    return (
        method_scores.agg(
            (F.max(F.when(is_candidate, quality)) > F.max(F.when(is_base, quality))).alias("quality_above_baselines"),
            (F.max(F.when(is_candidate, noise)) <= F.min(F.when(is_base, noise))).alias("noise_not_above_baselines"),
        )
        .withColumns({"complete": complete, "wins_above_rate": wins})
        .withColumn(
            "improved",
            F.col("complete")
            & F.col("quality_above_baselines")
            & F.col("wins_above_rate")
            & F.col("noise_not_above_baselines"),
        )
    )
