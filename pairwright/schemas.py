"""Record schemas and typed loads (explicit schema, defaults filled in by the plan)."""

from pyspark.sql import Column, DataFrame, functions as F

METADATA = "MAP<STRING,STRING>"

PROMPT = f"prompt_id STRING, prompt STRING, source STRING, metadata {METADATA}"
ANSWER = f"prompt_id STRING, kind STRING, text STRING, model STRING, metadata {METADATA}"
PAIR = f"prompt_id STRING, prompt STRING, chosen STRING, rejected STRING, metadata {METADATA}"
REQUEST = (
    f"prompt_id STRING, source_prompt STRING, generation_prompt STRING, model STRING, metadata {METADATA}"
)
METHOD_OUTPUT = (
    "prompt_id STRING, prompt STRING, method STRING, final_answer STRING, latency_ms DOUBLE, "
    "verifier_call_count DOUBLE, source_model STRING, source_run_id STRING"
)
TRAINER_STATE = (
    "global_step BIGINT, best_metric DOUBLE, best_model_checkpoint STRING, "
    "log_history ARRAY<MAP<STRING,STRING>>"
)

_REQUIRED = {
    "prompt": ["prompt_id", "prompt"],
    "answer": ["prompt_id"],
    "pair": ["prompt_id", "prompt", "chosen", "rejected"],
}
_DEFAULTS = {
    "prompt": {"source": "unknown"},
    "answer": {"kind": "answer", "text": "", "model": "unknown"},
    "pair": {},
}


def empty_map() -> Column:
    return F.expr("CAST(map() AS MAP<STRING,STRING>)")


def metadata_map(col: Column | None) -> Column:
    return empty_map() if col is None else F.coalesce(col, empty_map())


def typed(df: DataFrame, record: str, extra: list[str] = ()) -> DataFrame:
    """Cast a raw table to a record type: defaults for absent fields, an error for a missing required one.

    ``extra`` keeps further columns (an ingest sequence number, for instance).
    """
    columns = []
    for name in _REQUIRED[record]:
        if name not in df.columns:
            raise ValueError(f"{record} table lacks required column {name}")
        value = F.col(name).cast("string")
        columns.append(
            F.when(value.isNotNull(), value)
            .otherwise(F.raise_error(F.lit(f"{record}.{name} is missing")).cast("string"))
            .alias(name)
        )
    for name, default in _DEFAULTS[record].items():
        value = F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)
        columns.append(value.alias(name))
    columns.append(metadata_map(F.col("metadata") if "metadata" in df.columns else None).alias("metadata"))
    return df.select(*columns, *extra)
