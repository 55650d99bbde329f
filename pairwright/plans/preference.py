"""Preference preparation from prompt and answer tables to exports."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from pairwright.operators.checks import check_columns
from pairwright.operators.preference import build_preference_pairs
from pairwright.operators.requests import column_or, generation_requests
from pairwright.operators.scoring import Scorer, run_generation, score_pairs, validate_scores
from pairwright.operators.splits import split_by_id
from pairwright.sources.exports import export_preferences, export_reward, export_sft
from pairwright.sources.jsonl import append_jsonl


def prepare_preferences(
    prompts: DataFrame, chosen: DataFrame, rejected: DataFrame,
    similarity_threshold: float = 0.94, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 13,
    root: str | None = None, order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Split pairs and the report; with ``root`` both are also written."""
    pairs, report = build_preference_pairs(prompts, chosen, rejected, similarity_threshold, order)
    split = split_by_id(pairs, "prompt_id", train_ratio, val_ratio, seed)
    if root:
        export_preferences(split, report, root)
    return split, report


def score_and_validate(pairs: DataFrame, scorer: Scorer, min_accuracy: float = 0.65) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored pairs, validation report, failing pairs."""
    scored = score_pairs(pairs, scorer)
    report, failures = validate_scores(scored, min_accuracy)
    return scored, report, failures


def generation_run(
    prompts: DataFrame, open_client: Callable[[str], Callable[[], object]], root: str,
    model: str, done: dict[str, DataFrame] | None = None, name: str = "preference", **settings,
) -> dict[str, DataFrame]:
    """Render, generate (resuming), pair, split, export and check in one go.

    ``open_client(mode)`` gives the client factory of a mode; ``done`` holds earlier answers
    by mode.  Answers keep an ingest number, earlier ones first.
    """
    spark = prompts.sparkSession
    answers, errors = {}, {}
    for mode in ("positive", "negative"):
        earlier = (done or {}).get(mode)
        fresh, errors[mode] = run_generation(
            generation_requests(prompts, mode, model), open_client(mode), earlier, **settings
        )
        path = f"{root}/answers_{mode}"
        # the time of the append orders the runs of one root; answers of no known run come first
        fresh = fresh.withColumn("seq", F.lit(time.time_ns()))
        append_jsonl(fresh, path)
        landed = spark.read.schema(fresh.schema).json(path)
        answers[mode] = (
            landed if earlier is None
            else earlier.withColumn("seq", column_or(earlier, "seq", 0).cast("long")).select(*fresh.columns).unionByName(landed)
        )
    split, report = prepare_preferences(prompts, answers["positive"], answers["negative"], root=f"{root}/preference")
    export_reward(split, f"{root}/rm", name)
    export_sft(split, f"{root}/sft", f"{name}_sft")
    checks = check_columns(
        spark.read.json(f"{root}/rm/train_rm"), ["instruction", "input", "chosen", "rejected"]
    )
    return {"split": split, "report": report, "checks": checks, "errors": errors["positive"].unionByName(errors["negative"])}
