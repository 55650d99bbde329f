"""JSON lines: strict scan, scan with quarantine, sorted-key sink, append sink."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwright.functions.text import is_blank

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan with an explicit schema; blank lines are skipped and a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_quarantine(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed lines with the file they stand in."""
    lines = (
        spark.read.text(path)
        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
        .where(~is_blank(F.col("line")))
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, {CORRUPT} STRING", options))
    bad = F.col(f"row.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("row.*").drop(CORRUPT), parsed.where(bad).select("file", "line")


def with_sequence(df: DataFrame) -> DataFrame:
    """Add ``seq``, an ingest position that grows in file and line order within one scan."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def _sorted(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite, keys in alphabetical order, nulls written as such."""
    _sorted(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    _sorted(df).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_summary(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A single JSON object spread over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary table of one or few rows as one file with sorted keys."""
    _sorted(df).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
