"""Trainer-state files of many runs at once."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwright.schemas import TRAINER_STATE


def read_trainer_states(spark: SparkSession, root: str) -> DataFrame:
    """One state per run folder below ``root``: the file in the folder itself, else the newest checkpoint's."""
    files = (
        spark.read.schema(TRAINER_STATE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "trainer_state.json")
        .json(root)
        .select(
            "*",
            F.col("_metadata.file_path").alias("state_path"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )
    folder = F.regexp_replace("state_path", r"/trainer_state\.json$", "")
    checkpoint = F.regexp_like(folder, F.lit(r"/checkpoint-[^/]*$"))
    placed = files.withColumns(
        {
            "run": F.when(checkpoint, F.regexp_replace(folder, r"/checkpoint-[^/]*$", "")).otherwise(folder),
            "direct": ~checkpoint,
        }
    )
    state = F.struct("global_step", "best_metric", "best_model_checkpoint", "log_history", "state_path")
    return (
        placed.groupBy("run")
        .agg(F.max_by(state, F.struct("direct", "modified", "state_path")).alias("s"))
        .select("run", "s.*")
    )
