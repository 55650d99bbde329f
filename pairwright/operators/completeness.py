"""Merge the outputs of several methods and report what is missing, extra, repeated or empty."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.functions.text import is_blank
from pairwright.operators.joins import keyed_join, last_by_key
from pairwright.operators.requests import column_or

Outputs = Mapping[str, tuple[DataFrame, str]]


def normalised(outputs: DataFrame, method: str, answer: str, order: str | None = None) -> DataFrame:
    """A method's raw output in the merged schema."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in outputs.columns else F.lit(0.0)

    model = [F.col(c) for c in ("model", "generator_model") if c in outputs.columns]
    return outputs.select(
        F.col("prompt_id").cast("string").alias("prompt_id"),
        column_or(outputs, "prompt", "").alias("prompt"),
        F.lit(method).alias("method"),
        column_or(outputs, answer, "").alias("final_answer"),
        number("latency_ms").alias("latency_ms"),
        number("verifier_call_count").alias("verifier_call_count"),
        F.coalesce(*model, F.lit("")).alias("source_model"),
        column_or(outputs, "run_id", "").alias("source_run_id"),
        *([F.col(order).alias("seq")] if order else []),
    )


def _all_outputs(outputs: Outputs, order: str) -> DataFrame:
    tables = [normalised(df, method, answer, order) for method, (df, answer) in outputs.items()]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union


def merge_outputs(expected: DataFrame, outputs: Outputs, order: str = "seq") -> DataFrame:
    """One row per expected prompt and method that answered it; a method's last answer wins.

    ``position`` is the method's place; ``place`` is the prompt's, where ``expected`` has ``order``.
    """
    place = [F.col(order).alias("place")] if order in expected.columns else []
    position = F.array_position(F.array(*map(F.lit, outputs)), F.col("method"))
    latest = last_by_key(_all_outputs(outputs, order), ["prompt_id", "method"], "seq").drop("seq")
    wanted = expected.select(
        F.col("prompt_id").cast("string").alias("prompt_id"), F.explode(F.array(*map(F.lit, outputs))).alias("method"), *place
    )
    return keyed_join(wanted, latest, ["prompt_id", "method"], "inner").withColumn("position", position)


def _presence(expected: DataFrame, union: DataFrame, methods: list[str]) -> DataFrame:
    """One row per prompt id and method: expected rows, output rows."""
    marks = union.select("prompt_id", F.col("method")).unionByName(
        expected.select(F.col("prompt_id").cast("string").alias("prompt_id"), F.lit(None).cast("string").alias("method"))
    )
    per_id = marks.groupBy("prompt_id").agg(
        F.count_if(F.col("method").isNull()).alias("wanted"),
        *(F.count_if(F.col("method") == m).alias(f"n_{i}") for i, m in enumerate(methods)),
    )
    cells = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"n_{i}").alias("n")) for i, m in enumerate(methods)))
    return per_id.select("prompt_id", "wanted", F.explode(cells).alias("c")).select("prompt_id", "wanted", "c.*")


def _samples(rows: DataFrame, kind: str, size: int, order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("method").orderBy(*order))
    return (
        rows.select("method", "prompt_id", place.alias("place"))
        .where(F.col("place") <= size)
        .select("method", F.lit(kind).alias("kind"), "place", "prompt_id")
    )


def completeness_report(expected: DataFrame, outputs: Outputs, order: str = "seq", sample: int = 20) -> DataFrame:
    """One row per method: rows, four defect counts with id samples, and an ``ok`` flag."""
    methods = list(outputs)
    union = _all_outputs(outputs, order)
    presence = _presence(expected, union, methods)
    wanted, n = F.col("wanted"), F.col("n")
    missing, extra, repeated = (wanted > 0) & (n == 0), (wanted == 0) & (n > 0), n > 1
    counts = presence.groupBy("method").agg(
        F.sum("wanted").alias("expected_rows"),
        F.sum("n").alias("rows"),
        F.count_if(missing).alias("missing_count"),
        F.count_if(extra).alias("extra_count"),
        F.count_if(repeated).alias("duplicate_count"),
        F.sum(F.when(n > 0, wanted).otherwise(0)).alias("merged_rows"),
    )
    blank = union.where(is_blank(F.col("final_answer"))).select("method", "prompt_id", "seq")
    blanks = blank.groupBy("method").agg(F.count(F.lit(1)).alias("empty_count"))
    picked = (
        _samples(presence.where(missing), "missing", sample, ["prompt_id"])
        .unionByName(_samples(presence.where(extra), "extra", sample, ["prompt_id"]))
        .unionByName(_samples(presence.where(repeated), "duplicates", sample, ["prompt_id"]))
        .unionByName(_samples(blank, "empty", sample, ["seq"]))
        .groupBy("method")
        .agg(
            *(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "prompt_id")))),
                    lambda x: x["prompt_id"],
                ).alias(k)
                for k in ("missing", "extra", "duplicates", "empty")
            )
        )
    )
    zero, none = F.lit(0).cast("long"), F.expr("CAST(array() AS ARRAY<STRING>)")
    defects = ["missing_count", "extra_count", "duplicate_count", "empty_count"]
    # one row per method named by the caller
    report = (
        counts.join(F.broadcast(blanks), "method", "left")
        .join(F.broadcast(picked), "method", "left")
        .withColumn("empty_count", F.coalesce("empty_count", zero))
        .withColumns({k: F.coalesce(k, none) for k in ("missing", "extra", "duplicates", "empty")})
    )
    clean = F.col("rows") == F.col("expected_rows")
    for defect in defects:
        clean = clean & (F.col(defect) == 0)
    return report.select(
        "method", "rows", "expected_rows", "merged_rows", *defects, "missing", "extra", "duplicates", "empty", clean.alias("ok")
    )


def defect_ids(expected: DataFrame, outputs: Outputs, order: str = "seq") -> DataFrame:
    """Every defect, none left out: one row per method, id and defect, and one for each blank answer."""
    union = _all_outputs(outputs, order)
    wanted, n = F.col("wanted"), F.col("n")
    kinds = F.array_compact(
        F.array(
            F.when((wanted > 0) & (n == 0), "missing"), F.when((wanted == 0) & (n > 0), "extra"), F.when(n > 1, "duplicate")
        )
    )
    found = _presence(expected, union, list(outputs)).select("method", "prompt_id", F.explode(kinds).alias("defect"))
    blank = union.where(is_blank(F.col("final_answer"))).select("method", "prompt_id", F.lit("empty").alias("defect"))
    return found.unionByName(blank)


def finished_prompts(outputs: DataFrame, methods: list[str], answer: str = "final_answer") -> DataFrame:
    """The ``prompt_id`` of each prompt that every method has answered, once and not with a blank."""
    per_id = outputs.groupBy("prompt_id").agg(
        F.count_if(is_blank(F.col(answer))).alias("blank"), *(F.count_if(F.col("method") == m).alias(f"n_{i}") for i, m in enumerate(methods))
    )
    once = F.col("blank") == 0
    for i in range(len(methods)):
        once &= F.col(f"n_{i}") == 1
    return per_id.where(once).select("prompt_id")


def overall_completeness(report: DataFrame) -> DataFrame:
    """One row over all methods: merged rows and whether everything is complete."""
    return report.agg(
        F.sum("merged_rows").alias("merged_rows"),
        (F.every("ok") & (F.sum("merged_rows") == F.sum("expected_rows"))).alias("ok"),
    )


def id_differences(expected: DataFrame, found: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Ids on one side only, marked ``missing`` (expected, not found) or ``extra``."""
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(
        found.select(key, F.lit(0).alias("e"), F.lit(1).alias("f"))
    )
    both = sides.groupBy(key).agg(F.max("e").alias("e"), F.max("f").alias("f"))
    return both.where(F.col("e") != F.col("f")).select(
        key, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side")
    )


def repeated_ids(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
