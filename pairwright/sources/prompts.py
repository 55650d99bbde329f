"""Generated prompt tables.

A prompt's position is a number in a mixed radix over the template dimensions, so each row
is computed from its own id: no cross product is built and a limit cuts the range itself.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairwright import fixed_values as fixed


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def generate_prompts(
    spark: SparkSession,
    limit: int = 5000,
    topics: list[tuple[str, str]] = fixed.TOPIC_CONCEPTS,
    scenarios: list[str] = fixed.SCENARIOS,
    requirements: list[str] = fixed.OUTPUT_REQUIREMENTS,
    tasks: list[tuple[str, str]] = fixed.TASK_TEMPLATES,
    source: str = "c_system_taxonomy",
    prefix: str = "taxonomy",
) -> DataFrame:
    """Prompts from every (topic and concept, scenario, requirement, task), the last varying fastest."""
    if limit < 1:
        raise ValueError(f"cannot make {limit} prompts")
    size = len(topics) * len(scenarios) * len(requirements) * len(tasks)
    n = F.col("id")
    task = n % len(tasks)
    requirement = F.floor(n / len(tasks)) % len(requirements)
    scenario = F.floor(n / (len(tasks) * len(requirements))) % len(scenarios)
    topic = F.floor(n / (len(tasks) * len(requirements) * len(scenarios)))
    concept = _pick([c for _, c in topics], topic)
    scenario_text, requirement_text = _pick(scenarios, scenario), _pick(requirements, requirement)
    body = F.replace(_pick([t for _, t in tasks], task), F.lit("{concept}"), concept)
    return spark.range(min(limit, size)).select(
        F.format_string(f"{prefix}-%06d", n + 1).alias("prompt_id"),
        F.concat(body, F.lit(" Frame the answer "), scenario_text, F.lit(". "), requirement_text).alias("prompt"),
        F.lit(source).alias("source"),
        F.create_map(
            F.lit("topic"), _pick([t for t, _ in topics], topic),
            F.lit("concept"), concept,
            F.lit("task_type"), _pick([k for k, _ in tasks], task),
            F.lit("scenario"), scenario_text,
            F.lit("output_requirement"), requirement_text,
        ).alias("metadata"),
    )


def guardrail_prompts(
    spark: SparkSession,
    limit: int = 30,
    cases: list[tuple[str, list[str], list[str], str]] = fixed.GUARDRAIL_CASES,
    task_type: str = "technical_qa",
) -> DataFrame:
    """Guardrail cases repeated in turn up to ``limit`` prompts."""
    if limit < 1:
        raise ValueError(f"cannot make {limit} prompts")
    case = F.element_at(
        F.array(
            *(
                F.struct(
                    F.lit(prompt).alias("prompt"),
                    F.array(*map(F.lit, keywords)).alias("expected_keywords"),
                    F.array(*map(F.lit, claims)).alias("unsafe_claims"),
                    F.lit(topic).alias("topic"),
                )
                for prompt, keywords, claims, topic in cases
            )
        ),
        (F.col("id") % len(cases) + 1).cast("int"),
    )
    return spark.range(limit).select("id", case.alias("c")).select(
        F.format_string("guardrail-%04d", F.col("id") + 1).alias("prompt_id"),
        "c.prompt",
        F.lit("code_ability_guardrail").alias("source"),
        "c.topic",
        F.lit(task_type).alias("task_type"),
        "c.expected_keywords",
        "c.unsafe_claims",
    )
