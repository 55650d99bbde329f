"""Projections that render generation, judge and training records."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from pairwright import fixed_values as fixed
from pairwright.functions.text import first_answer
from pairwright.functions.values import merge_maps, put
from pairwright.schemas import metadata_map

INSTRUCTIONS = {"negative": fixed.NEGATIVE_INSTRUCTIONS, "positive": fixed.POSITIVE_INSTRUCTIONS}


def column_or(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def answer_of(df: DataFrame) -> Column:
    """``final_answer``, else ``answer``, else the empty string (reports and judge requests)."""
    return first_answer(*(F.col(c) for c in ("final_answer", "answer") if c in df.columns))


def static_answer_of(df: DataFrame) -> Column:
    """``answer``, else ``final_answer``, else the empty string (static evaluation)."""
    return first_answer(*(F.col(c) for c in ("answer", "final_answer") if c in df.columns))


def generation_requests(
    prompts: DataFrame, mode: str, model: str, instructions: Mapping[str, str] = INSTRUCTIONS
) -> DataFrame:
    if mode not in instructions:
        raise ValueError(f"no instruction for mode {mode!r}, only for {sorted(instructions)}")
    return prompts.select(
        "prompt_id",
        F.col("prompt").alias("source_prompt"),
        F.concat(F.lit(instructions[mode] + "\n\nUser question:\n"), F.col("prompt"), F.lit("\n")).alias(
            "generation_prompt"
        ),
        F.lit(model).alias("model"),
        put(metadata_map(F.col("metadata")), source=F.col("source"), generation_mode=F.lit(mode)).alias("metadata"),
    )


def answer_records(responses: DataFrame) -> DataFrame:
    """Answers from generation responses.

    Input: request columns plus ``text``, ``logprob`` and ``response_metadata`` (null
    when nothing was generated) and optionally ``generator_model``.
    """
    request = metadata_map(F.col("metadata"))
    mode = F.coalesce(F.element_at(request, "generation_mode"), F.lit("positive"))
    base = put(request, source_prompt=F.coalesce(F.col("source_prompt"), F.lit("")))
    answered = merge_maps(
        put(base, generator_logprob=F.col("logprob")), metadata_map(F.col("response_metadata"))
    )
    model = [F.col(c) for c in ("generator_model", "model") if c in responses.columns]
    return responses.select(
        "prompt_id",
        F.when(mode == "positive", "chosen").otherwise("rejected").alias("kind"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(*model, F.lit("unknown")).alias("model"),
        F.when(F.col("text").isNotNull(), answered).otherwise(base).alias("metadata"),
    )


def baseline_records(responses: DataFrame, baseline: str, run_id: str) -> DataFrame:
    """Baseline answers: the prompt's metadata plus log-probability, finish reason and attempt."""
    return responses.select(
        "prompt_id",
        "prompt",
        F.lit("baseline").alias("kind"),
        F.lit(baseline).alias("baseline"),
        F.lit(run_id).alias("run_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        "model",
        put(
            metadata_map(F.col("metadata") if "metadata" in responses.columns else None),
            generator_logprob=F.coalesce(F.col("logprob"), F.lit(0.0)),
            finish_reason=F.col("finish_reason"),
            attempt=F.col("attempt"),
        ).alias("metadata"),
    )


def judge_requests(outputs: DataFrame, judge_model: str, dimensions: list[str] = fixed.JUDGE_DIMENSIONS) -> DataFrame:
    prompt_id, method = column_or(outputs, "prompt_id", ""), column_or(outputs, "method", "unknown")
    return outputs.select(
        F.concat(prompt_id, F.lit(":"), method).alias("request_id"),
        prompt_id.alias("prompt_id"),
        F.lit(judge_model).alias("model"),
        F.concat(
            F.lit(fixed.JUDGE_PREAMBLE.format(dimensions=", ".join(dimensions)) + "User prompt:\n"),
            column_or(outputs, "prompt", ""),
            F.lit("\n\nCandidate answer:\n"),
            answer_of(outputs),
            F.lit("\n"),
        ).alias("judge_prompt"),
        F.create_map(F.lit("method"), method).alias("metadata"),
    )


def reward_rows(pairs: DataFrame) -> DataFrame:
    """Reward-model training rows."""
    return pairs.select(
        F.col("prompt").alias("instruction"),
        F.lit("").alias("input"),
        "chosen",
        "rejected",
        put(metadata_map(F.col("metadata")), prompt_id=F.col("prompt_id")).alias("metadata"),
    )


def sft_rows(pairs: DataFrame) -> DataFrame:
    """Fine-tuning rows: the chosen answer only."""
    return pairs.select(
        F.col("prompt").alias("instruction"),
        F.lit("").alias("input"),
        F.col("chosen").alias("output"),
        put(metadata_map(F.col("metadata")), prompt_id=F.col("prompt_id")).alias("metadata"),
    )
