"""Evaluation runs over method outputs."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from pairwright.operators import compare, criteria, tables
from pairwright.operators.completeness import Outputs, completeness_report, merge_outputs
from pairwright.operators.guardrail import guardrail_details, guardrail_summary
from pairwright.operators.requests import judge_requests
from pairwright.operators.scoring import Scorer, score_outputs
from pairwright.session import landed
from pairwright.sources.csv_tables import write_csv
from pairwright.sources.jsonl import write_jsonl, write_summary


def static_evaluation(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-row metrics and their means by method."""
    rows = tables.static_metrics(outputs)
    return rows, tables.summarize_metrics(rows)


def evaluation_assets(
    outputs: DataFrame, methods: list[str], judge_model: str, root: str | None = None, order: str = "seq"
) -> dict[str, DataFrame]:
    """The three tables, the review sheet and the judge requests; the text is measured once.

    Only the numbers are kept between the tables, never the texts.
    """
    numbers = tables.method_numbers(outputs).persist(StorageLevel.MEMORY_AND_DISK)
    assets = {
        "overall": tables.overall_table(numbers),
        "errors": tables.error_breakdown(numbers),
        "latency": tables.latency_table(numbers),
        "review": tables.human_review_sheet(outputs, methods, order),
        "judge_requests": judge_requests(outputs, judge_model),
    }
    if root:
        for name in ("overall", "errors", "latency", "review"):
            write_csv(f"{root}/{name}", assets[name])
        write_jsonl(assets["judge_requests"], f"{root}/judge_requests")
    return assets


def guardrail_evaluation(outputs: DataFrame, prompts: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    details = guardrail_details(outputs, prompts)
    summary = guardrail_summary(details)
    if root:
        write_csv(f"{root}/details", details)
        write_summary(summary, f"{root}/summary")
    return details, summary


def merge_score_compare(
    expected: DataFrame, outputs: Outputs, scorer: Scorer, candidate: str, references: list[str], order: str = "seq"
) -> dict[str, DataFrame]:
    """Merged outputs, completeness, scores, score summary and win/loss table.

    Merged rows come prompt by prompt as ``expected`` orders them, a prompt's methods in the
    order of ``outputs``; without an order there they are taken by prompt id.
    """
    merged = merge_outputs(expected, outputs, order)
    place = F.col("place") if "place" in merged.columns else F.lit(0)
    arrival = F.struct(place.cast("long").alias("place"), F.col("position"))
    scores = score_outputs(merged.withColumn("seq", arrival), scorer, ("seq",)).persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "merged": merged,
        "completeness": completeness_report(expected, outputs, order),
        "scores": scores,
        "summary": compare.score_summary(scores),
        "pairwise": compare.pairwise(scores, candidate, references),
    }


def criteria_evaluation(
    pairs: DataFrame, outputs: DataFrame, scores: DataFrame, order: str = "seq"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid metrics, chosen criterion, method table under it."""
    grid = criteria.search_criteria(pairs).persist()
    chosen = criteria.choose_criterion(grid)
    return criteria.ranked_criteria(grid), chosen, criteria.score_methods(outputs, scores, chosen, order)


def method_metrics(outputs: DataFrame) -> DataFrame:
    """The three per-method tables as one; the text is measured once."""
    # written once: branches of a plan that read persisted rows at a time would each measure them on their own executors
    numbers = landed(tables.method_numbers(outputs), "method-numbers")
    return tables.join_metric_tables(
        tables.overall_table(numbers), tables.error_breakdown(numbers), tables.latency_table(numbers)
    )


def main_results(
    outputs: DataFrame, scores: DataFrame, method_scores: DataFrame, methods: list[str]
) -> DataFrame:
    metrics = method_metrics(outputs)
    return tables.results_table(metrics, method_scores, compare.score_summary(scores), methods)
