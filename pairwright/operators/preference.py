"""Preference pairs: prompt, chosen answer, rejected answer, with drop reasons and a report."""

from pyspark.sql import DataFrame, functions as F

from pairwright.functions.similarity import near_duplicate
from pairwright.functions.text import is_blank
from pairwright.functions.values import merge_maps
from pairwright.operators.joins import keyed_join, winners
from pairwright.schemas import metadata_map
from pairwright.session import landed

MISSING, EMPTY, DUPLICATE = "missing_answer", "empty", "near_duplicate"


def answers_by_prompt(chosen: DataFrame, rejected: DataFrame, order: str) -> DataFrame:
    """Last chosen and last rejected answer per prompt id; texts of answers that were replaced do not travel twice."""
    columns = ["prompt_id", "text", "model", "metadata", order]
    both = (
        chosen.select(*columns, F.lit(True).alias("good"))
        .unionByName(rejected.select(*columns, F.lit(False).alias("good")))
    )
    last = winners(both, ["prompt_id", "good"], order).withColumn("answer", F.struct("text", "model", "metadata"))
    good, bad = (last.where(F.col("good") == side).select("prompt_id", F.col("answer").alias(name)) for side, name in ((True, "chosen_answer"), (False, "rejected_answer")))
    return good.join(bad, "prompt_id", "full")


def judge_pairs(
    prompts: DataFrame,
    chosen: DataFrame,
    rejected: DataFrame,
    similarity_threshold: float = 0.94,
    order: str = "seq",
) -> DataFrame:
    """Every prompt row with its answers and a ``drop_reason`` (null for a kept pair).

    Reasons are tried in the order missing answer, empty text, near duplicate.  Answers
    need an ingest sequence column ``order``; the last answer of a prompt id wins.
    """
    joined = keyed_join(
        prompts.select("prompt_id", "prompt", "source", "metadata"),
        answers_by_prompt(chosen, rejected, order),
        ["prompt_id"],
        "left",
    )
    missing = F.col("chosen_answer").isNull() | F.col("rejected_answer").isNull()
    empty = is_blank(F.col("prompt")) | is_blank(F.col("chosen_answer.text")) | is_blank(F.col("rejected_answer.text"))
    duplicate = near_duplicate(
        F.col("chosen_answer.text"), F.col("rejected_answer.text"), similarity_threshold, where=~missing & ~empty
    )
    return joined.withColumn(
        "drop_reason", F.when(missing, MISSING).when(empty, EMPTY).when(duplicate, DUPLICATE)
    )


def kept_pairs(judged: DataFrame) -> DataFrame:
    """Pair records; metadata of the prompt, then source and models, then the rejected answer's, later wins."""
    origin = F.create_map(
        F.lit("source"), F.col("source"),
        F.lit("chosen_model"), F.col("chosen_answer.model"),
        F.lit("rejected_model"), F.col("rejected_answer.model"),
    )
    metadata = merge_maps(metadata_map(F.col("metadata")), origin, metadata_map(F.col("rejected_answer.metadata")))
    return judged.where(F.col("drop_reason").isNull()).select(
        "prompt_id",
        "prompt",
        F.col("chosen_answer.text").alias("chosen"),
        F.col("rejected_answer.text").alias("rejected"),
        metadata.alias("metadata"),
    )


def preference_report(judged: DataFrame) -> DataFrame:
    """One row of counters."""
    reason = F.col("drop_reason")
    return judged.agg(
        F.count(F.lit(1)).alias("total_prompts"),
        F.count_if(reason.isNull()).alias("kept_pairs"),
        F.count_if(reason == MISSING).alias("dropped_missing_answer"),
        F.count_if(reason == EMPTY).alias("dropped_empty"),
        F.count_if(reason == DUPLICATE).alias("dropped_near_duplicate"),
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The report as (counter, value) rows."""
    return report.unpivot([], list(report.columns), "counter", "value")


def build_preference_pairs(
    prompts: DataFrame,
    chosen: DataFrame,
    rejected: DataFrame,
    similarity_threshold: float = 0.94,
    order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Pairs and report.  Both read the judged table, which is written once to the shared folder."""
    judged = landed(judge_pairs(prompts, chosen, rejected, similarity_threshold, order), "judged-pairs")
    return kept_pairs(judged), preference_report(judged)


def within_length(prompts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Prompts of an allowed length in characters."""
    return prompts.where(F.length("prompt").between(shortest, longest))
