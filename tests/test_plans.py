"""Physical plans: what is read, what is shuffled, how joins run."""

import re

import pytest

from pyspark.sql import functions as F

from pairwright.operators import compare, joins, preference, splits, tables
from querybook import registry
from querybook.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["preference_pairs", "split_assign", "merged_outputs", "pairwise", "criteria_grid", "method_scores",
     "results_table", "human_preference", "guardrail_details", "regressions", "lookahead_select", "score_validation"],
)
def test_no_cross_products(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_used_columns_are_read(spark, tmp_path):
    registry.outputs_of(spark, SF).write.parquet(f"{tmp_path}/outputs")
    outputs = spark.read.parquet(f"{tmp_path}/outputs")
    read = re.search(r"ReadSchema: struct<(.*?)>", plan_of(tables.latency_table(outputs))).group(1)
    assert set(part.split(":")[0] for part in read.split(",")) == {"method", "latency_ms", "verifier_call_count"}
    kept = plan_of(tables.error_breakdown(outputs.where(F.col("method") == "beam")))
    assert re.search(r"PushedFilters: \[.*EqualTo\(method,beam\)", kept)


def test_unread_metrics_are_not_computed(spark, tmp_path):
    registry.outputs_of(spark, SF).write.parquet(f"{tmp_path}/outputs")
    plan = plan_of(tables.overall_table(spark.read.parquet(f"{tmp_path}/outputs")))
    assert "array_distinct" not in plan  # the repeated-line metric


def test_texts_are_not_shuffled(spark, tmp_path):
    registry.outputs_of(spark, SF).write.parquet(f"{tmp_path}/outputs")
    plan = plan_of(tables.error_breakdown(spark.read.parquet(f"{tmp_path}/outputs")))
    assert "partial_sum" in plan  # combined before the shuffle


def test_samples_are_cut_before_the_shuffle(spark):
    scores = spark.createDataFrame([("p1", "a", 1.0, 0), ("p1", "b", 2.0, 1)], "prompt_id STRING, method STRING, score DOUBLE, seq INT")
    assert "WindowGroupLimit" in plan_of(compare.pairwise(scores, "a", ["b"]))


def test_heavy_keys_are_salted_in_one_pass(spark, tmp_path):
    spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id").write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    right = spark.range(3000).groupBy((F.col("id") % 100).alias("k")).agg(F.max("id").alias("m"))
    joined = joins.keyed_join(left, right, ["k"], "left", joins.heavy_keys(left, ["k"], min_rows=500), salts=8)
    plan = plan_of(joined)
    assert plan.count("FileScan") == 1 and "Union" not in plan and "_salt" in plan
    assert joined.count() == 3000 and joined.where("k = 0 AND m = 2900").count() == 1500
    # dealt out: no partition holds most of the heavy key
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sizes = joins.keyed_join(left, right, ["k"], "left", joins.heavy_keys(left, ["k"], min_rows=500), salts=64).where("k = 0").groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in sizes.collect()) < 900
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_a_join_without_heavy_keys_starts_no_job(spark):
    left, right = spark.range(10).toDF("k"), spark.range(5).toDF("k")
    spark.sparkContext.setJobGroup("quiet", "none")
    joins.keyed_join(left, right, ["k"], "left_anti")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quiet")


@pytest.mark.parametrize("name", ["last_wins", "first_wins", "merged_outputs", "human_review_sheet"])
def test_winners_are_found_without_their_texts(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_pairs_are_judged_without_sorting_texts(spark):
    answers = spark.createDataFrame([("p", "t", "m", {"a": "b"}, 1)], "prompt_id STRING, text STRING, model STRING, metadata MAP<STRING,STRING>, seq INT")
    prompts = spark.createDataFrame([("p", "q", "s", None)], "prompt_id STRING, prompt STRING, source STRING, metadata MAP<STRING,STRING>")
    assert "SortAggregate" not in plan_of(preference.judge_pairs(prompts, answers, answers))


def test_split_membership_needs_no_join(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("prompt_id"), F.lit("x").alias("body"))
    main = plan_of(splits.split_by_id(df)).split("Subquery")[0]
    assert "Join" not in main and "Exchange" not in main


def test_every_query_but_the_similarity_one_has_reference_sql():
    assert set(registry.QUERIES) - set(ORACLES) == {"near_duplicate_answers"}
    assert set(ORACLES) <= set(registry.QUERIES)
