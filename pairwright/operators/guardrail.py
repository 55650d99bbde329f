"""Required-keyword and unsafe-claim checks of answers."""

from pyspark.sql import Column, DataFrame, functions as F

from pairwright.functions.text import contains_term, folds_to_ascii
from pairwright.operators.joins import dimension_join, last_by_key
from pairwright.operators.requests import answer_of, column_or


def guardrail_details(outputs: DataFrame, prompts: DataFrame, order: str | None = None) -> DataFrame:
    """One row per output: missing keywords, unsafe claims, verdict.

    ``prompts`` has prompt_id, topic, expected_keywords and unsafe_claims; with ``order``
    the last row of a repeated prompt id is used.  An output of an unknown prompt is an error.
    """
    columns = ["prompt_id", "topic", "expected_keywords", "unsafe_claims"]
    known = prompts.select(*columns, *([order] if order else []))
    if order:
        known = last_by_key(known, ["prompt_id"], order).select(*columns)
    rows = outputs.select(
        "prompt_id", column_or(outputs, "method", "unknown").alias("method"), answer_of(outputs).alias("answer")
    )
    joined = dimension_join(rows, known.withColumn("known", F.lit(True)), ["prompt_id"], "left")
    checked = F.when(F.col("known"), F.col("answer")).otherwise(
        F.raise_error(F.concat(F.lit("no guardrail prompt "), "prompt_id"))
    )
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    answer = F.col("answer")

    def holds(term: Column) -> Column:
        return contains_term(answer, term, F.col("lowered"), F.col("folding"))

    return (
        joined.withColumn("answer", checked)
        .withColumns({"lowered": F.lower("answer"), "folding": folds_to_ascii(answer)})
        .select(
            "prompt_id",
            "method",
            F.coalesce("topic", F.lit("")).alias("topic"),
            F.filter(F.coalesce("expected_keywords", none), lambda k: ~holds(k)).alias("missing"),
            F.filter(F.coalesce("unsafe_claims", none), lambda k: holds(k)).alias("unsafe"),
            F.length("answer").alias("answer_length"),
        )
        .select(
            "prompt_id",
            "method",
            "topic",
            ((F.size("missing") == 0) & (F.size("unsafe") == 0)).alias("passed"),
            F.array_join("missing", ", ").alias("missing_keywords"),
            F.array_join("unsafe", ", ").alias("unsafe_claims"),
            "answer_length",
        )
    )


def guardrail_summary(details: DataFrame) -> DataFrame:
    """Counts and pass rate per method and over all methods (``scope`` all, method null)."""
    passed = F.count_if(F.col("passed"))
    counts = [F.count(F.lit(1)).alias("count"), passed.alias("passed_count"), F.count_if(F.col("unsafe_claims") != "").alias("unsafe_claim_count")]
    per_method = details.groupBy("method").agg(*counts)
    # the overall row is folded from the per-method rows and exists for empty input too
    overall = per_method.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("count", "passed_count", "unsafe_claim_count")))
    return (
        per_method.withColumn("scope", F.lit("method"))
        .unionByName(overall.withColumns({"scope": F.lit("all"), "method": F.lit(None).cast("string")}))
        .select(
            "scope",
            "method",
            "count",
            "passed_count",
            F.coalesce(F.try_divide("passed_count", "count"), F.lit(0.0)).alias("pass_rate"),
            "unsafe_claim_count",
        )
    )
