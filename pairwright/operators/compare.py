"""Score comparison between methods.

Scores are brought to one wide row per prompt by conditional aggregation, so comparing a
candidate with any number of references is one shuffle on the prompt id and no self-join.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.functions.text import first_answer
from pairwright.operators.quantiles import stats_with_median
from pairwright.operators.requests import column_or


def score_summary(scores: DataFrame) -> DataFrame:
    """Count, mean, exact median, minimum and maximum score by method."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    df = scores.select(column_or(scores, "method", "unknown").alias("method"), score.alias("score"))
    return stats_with_median(
        df,
        ["method"],
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("score").alias("mean"),
            F.min("score").alias("min"),
            F.max("score").alias("max"),
        ],
        "score",
        "median",
    ).select("method", "count", "mean", "median", "min", "max")


def _last_score(method: Column, name: str, order: str) -> Column:
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    return F.max_by(F.when(method == name, score), F.when(method == name, F.col(order)))


def scores_by_prompt(scores: DataFrame, methods: list[str], order: str = "seq") -> DataFrame:
    """One row per prompt: last score of each listed method, and the first position of the prompt."""
    method = column_or(scores, "method", "unknown")
    return scores.groupBy(column_or(scores, "prompt_id", "").alias("prompt_id")).agg(
        F.min(order).alias("first_seen"), *(_last_score(method, m, order).alias(f"score_{i}") for i, m in enumerate(methods))
    )


def compared_scores(scores: DataFrame, candidate: str, references: list[str], order: str = "seq") -> DataFrame:
    """reference, prompt_id, first_seen, mine, other: one row per prompt that both methods have scored."""
    wide = scores_by_prompt(scores, [candidate, *references], order)
    against = F.explode(
        F.array(
            *(
                F.struct(F.lit(r).alias("reference"), F.col(f"score_{i}").alias("other"))
                for i, r in enumerate(references, start=1)
            )
        )
    )
    return (
        wide.select("prompt_id", "first_seen", F.col("score_0").alias("mine"), against.alias("a"))
        .select("prompt_id", "first_seen", "mine", "a.reference", "a.other")
        .where(F.col("mine").isNotNull() & F.col("other").isNotNull())
    )


def losses(scores: DataFrame, candidate: str, references: list[str], order: str = "seq") -> DataFrame:
    """Every lost prompt: candidate, reference, prompt_id, mine, other."""
    lost = compared_scores(scores, candidate, references, order).where(F.col("mine") < F.col("other"))
    return lost.select(F.lit(candidate).alias("candidate"), "reference", "prompt_id", "mine", "other")


def pairwise(
    scores: DataFrame, candidate: str, references: list[str], order: str = "seq", sample: int = 50
) -> DataFrame:
    """Wins, losses, ties, win rate against each reference method, and a short list of losing prompt ids.

    ``loss_ids`` holds the first ``sample`` only; ``losses`` has them all.
    """
    compared = compared_scores(scores, candidate, references, order)
    counts = compared.groupBy("reference").agg(
        F.count_if(F.col("mine") > F.col("other")).alias("wins"),
        F.count_if(F.col("mine") < F.col("other")).alias("losses"),
        F.count_if(F.col("mine") == F.col("other")).alias("ties"),
        F.count(F.lit(1)).alias("compared"),
    )
    place = F.row_number().over(Window.partitionBy("reference").orderBy("first_seen", "prompt_id"))
    lost = (
        compared.where(F.col("mine") < F.col("other"))
        .select("reference", "prompt_id", place.alias("place"))
        .where(F.col("place") <= sample)
        .groupBy("reference")
        .agg(F.array_sort(F.collect_list(F.struct("place", "prompt_id"))).alias("ids"))
        .select("reference", F.transform("ids", lambda x: x["prompt_id"]).alias("loss_ids"))
    )
    listed = scores.sparkSession.createDataFrame([(r,) for r in references], "reference STRING")
    zero = F.lit(0).cast("long")
    return (
        listed.join(F.broadcast(counts), "reference", "left")
        .join(F.broadcast(lost), "reference", "left")
        .select(
            F.lit(candidate).alias("candidate"),
            "reference",
            *(F.coalesce(c, zero).alias(c) for c in ("wins", "losses", "ties", "compared")),
            F.coalesce(F.try_divide("wins", "compared"), F.lit(0.0)).alias("win_rate"),
            F.coalesce("loss_ids", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("loss_ids"),
        )
    )


def regressions(
    scores: DataFrame, outputs: DataFrame, candidate: str, base: str, n: int = 12, order: str = "seq"
) -> DataFrame:
    """The ``n`` prompts where the candidate falls furthest below the base method, with both answers."""
    wide = scores_by_prompt(scores, [base, candidate], order)
    worst = (
        wide.select("prompt_id", (F.col("score_1") - F.col("score_0")).alias("margin"))
        .where(F.col("margin") < 0)
        .orderBy("margin", "prompt_id")
        .limit(n)
    )
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    last = (
        scores.join(F.broadcast(worst), "prompt_id")
        .groupBy("prompt_id", "method")
        .agg(F.max_by(score, F.col(order)).alias("score"))
        .groupBy("prompt_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "score")))).alias("scores"))
    )
    method = F.col("method")

    def latest(name: str, value: Column) -> Column:
        return F.max_by(F.when(method == name, value), F.when(method == name, F.col(order)))

    texts = (
        outputs.where(method.isin(candidate, base))
        .join(F.broadcast(worst.select("prompt_id")), "prompt_id")
        .groupBy("prompt_id")
        .agg(
            latest(candidate, column_or(outputs, "prompt", "")).alias("prompt"),
            latest(base, F.col("final_answer")).alias("base_answer"),
            latest(candidate, F.col("final_answer")).alias("candidate_answer"),
        )
    )
    return (
        worst.join(last, "prompt_id", "left")
        .join(texts, "prompt_id", "left")
        .select(
            "prompt_id",
            "margin",
            "scores",
            *(first_answer(F.col(c)).alias(c) for c in ("prompt", "base_answer", "candidate_answer")),
        )
        .orderBy("margin", "prompt_id")
    )
