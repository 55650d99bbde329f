"""Summaries of trainer logs, row-local: the log of a run is one array of sparse entries."""

from pyspark.sql import Column, DataFrame, functions as F


def _last_value(history: Column, key: str) -> Column:
    having = F.filter(history, lambda entry: F.map_contains_key(entry, key))
    return F.element_at(F.try_element_at(having, F.lit(-1)), key).try_cast("double")


def summarize_runs(states: DataFrame) -> DataFrame:
    """One row per trainer state: steps, best metric, entry count, last entry, last losses."""
    history = F.coalesce("log_history", F.expr("CAST(array() AS ARRAY<MAP<STRING,STRING>>)"))
    empty = F.expr("CAST(map() AS MAP<STRING,STRING>)")
    known = [c for c in ("run", "state_path") if c in states.columns]
    return states.select(
        *known,
        F.coalesce("global_step", F.lit(0)).alias("global_step"),
        "best_metric",
        F.coalesce("best_model_checkpoint", F.lit("")).alias("best_model_checkpoint"),
        F.size(history).alias("log_history_count"),
        F.coalesce(F.try_element_at(history, F.lit(-1)), empty).alias("last_metrics"),
        _last_value(history, "loss").alias("last_train_loss"),
        _last_value(history, "eval_loss").alias("last_eval_loss"),
        (F.size(history) > 0).alias("ok"),
    )
