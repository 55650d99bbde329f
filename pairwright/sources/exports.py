"""Training-set exports."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwright.operators.preference import report_lines
from pairwright.operators.requests import reward_rows, sft_rows
from pairwright.sources.jsonl import write_jsonl, write_summary

_MANIFEST = "dataset STRING, file_name STRING, ranking BOOLEAN, columns MAP<STRING,STRING>"
_REWARD_COLUMNS = {"prompt": "instruction", "query": "input", "chosen": "chosen", "rejected": "rejected"}
_SFT_COLUMNS = {"prompt": "instruction", "query": "input", "response": "output"}


def reward_manifest(spark: SparkSession, name: str, train_file: str, val_file: str) -> DataFrame:
    rows = [(name, train_file, True, _REWARD_COLUMNS), (f"{name}_val", val_file, True, _REWARD_COLUMNS)]
    return spark.createDataFrame(rows, _MANIFEST)


def sft_manifest(spark: SparkSession, name: str, train_file: str) -> DataFrame:
    return spark.createDataFrame([(name, train_file, None, _SFT_COLUMNS)], _MANIFEST)


def export_reward(split: DataFrame, root: str, name: str) -> DataFrame:
    """Reward-model rows of train and val as JSON lines, and the manifest; returns the manifest."""
    for part in ("train", "val"):
        write_jsonl(reward_rows(split.where(F.col("split") == part)), f"{root}/{part}_rm")
    manifest = reward_manifest(split.sparkSession, name, "train_rm", "val_rm")
    write_summary(manifest, f"{root}/dataset_info")
    return manifest


def export_sft(split: DataFrame, root: str, name: str) -> DataFrame:
    """Fine-tuning rows of train as JSON lines, and the manifest; returns the manifest."""
    write_jsonl(sft_rows(split.where(F.col("split") == "train")), f"{root}/train_sft")
    manifest = sft_manifest(split.sparkSession, name, "train_sft")
    write_summary(manifest, f"{root}/dataset_info")
    return manifest


def export_preferences(split: DataFrame, report: DataFrame, root: str) -> None:
    """Train and val pairs by split, the test prompts without any answer, and the data report."""
    split.where(F.col("split").isin("train", "val")).write.mode("overwrite").partitionBy("split").json(f"{root}/pairs")
    write_jsonl(test_prompts(split), f"{root}/test_prompts")
    write_summary(report_lines(report), f"{root}/data_report")


def test_prompts(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "test").select("prompt_id", "prompt", "metadata")


test_prompts.__test__ = False  # not a test case
