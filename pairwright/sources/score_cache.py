"""Score cache: pairs already scored are read back, only new ones go to the scorer."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwright.operators.scoring import Scorer, score_pairs

SCORES = ["chosen_score", "rejected_score"]


def _exists(spark: SparkSession, path: str) -> bool:
    """Asked of the table's own file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def score_with_cache(pairs: DataFrame, scorer: Scorer, path: str, key: str = "prompt_id", scorer_name: str = "default") -> DataFrame:
    """Scores of all pairs, row by row.  New scores are appended to the parquet table at ``path``.

    The cache knows a pair by its content (prompt, both answers, name of the scorer), so a
    changed answer is scored anew, repeated ids and rows stay apart, and several scorers can
    share a table.  Ids and texts come from ``pairs``.
    """
    spark = pairs.sparkSession
    content = F.sha2(F.to_json(F.struct(F.lit(scorer_name).alias("scorer"), "prompt", "chosen", "rejected")), 256)
    marked = pairs.withColumn("pair_key", content)
    fresh = marked.select("pair_key", "prompt", "chosen", "rejected").dropDuplicates(["pair_key"])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("pair_key"), "pair_key", "left_anti")
    score_pairs(fresh, scorer).select("pair_key", *SCORES).write.mode("append").parquet(path)
    # two writers may have appended the same pair
    cached = spark.read.parquet(path).groupBy("pair_key").agg(*(F.max(c).alias(c) for c in SCORES))
    return marked.join(cached, "pair_key").select(key, "prompt", "chosen", "rejected", *SCORES)
