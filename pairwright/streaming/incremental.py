"""Incremental scoring and running metrics with Structured Streaming.

A file stream with a checkpoint replaces append-and-re-read: files seen once are never
scored again, and a restart continues where the last committed batch ended.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators.completeness import completeness_report, overall_completeness
from pairwright.operators.tables import with_metrics


def stream_json(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def stream_parquet(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Tables of a folder whose names match ``name`` as a stream; a table is a file or a folder of files."""
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")


def once_per_key(stream: DataFrame, key: str = "prompt_id", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """At most one row per key.

    Without an event time every key is remembered, which suits a closed set of prompts.
    With one, keys are forgotten after ``delay``, so the state stays bounded.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def append_to(stream: DataFrame, path: str, checkpoint: str, sink: str = "json", continuous: str | None = None) -> StreamingQuery:
    """Append a stream to files, exactly once; by default processes what is there and stops."""
    writer = stream.writeStream.format(sink).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start(path)


def running_tables(outputs: DataFrame) -> DataFrame:
    """Running form of the per-method tables; the state is one row per method."""
    measured = with_metrics(outputs)
    latency = F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0))
    calls = F.coalesce(F.col("verifier_call_count").cast("double"), F.lit(0.0))
    return measured.groupBy("method").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("abnormal_symbol_count").alias("abnormal_symbol_count_mean"),
        F.avg("word_count").alias("word_count_mean"),
        F.sum("repeated_line_count").alias("repeated_line_count_total"),
        F.avg(latency).alias("latency_ms_mean"),
        F.avg(calls).alias("verifier_call_count_mean"),
    )


def keep_latest(running: DataFrame, path: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Write the complete running table of each batch to a folder ``batch=<n>`` of its own below ``path``.

    A batch that is run again replaces its own folder only; :func:`read_latest` reads the
    newest one, so a reader never meets a table that is being replaced.
    """

    def land(batch: DataFrame, number: int) -> None:
        # a row per group; one file appears at once when it is committed
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = running.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(land)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest table that :func:`keep_latest` has written."""
    tables = spark.read.parquet(path)
    newest = tables.agg(F.max("batch")).scalar()
    return tables.where(F.col("batch") == newest).drop("batch")


def with_progress(df: DataFrame, name: str | Observation) -> DataFrame:
    """Named row counter, readable from an Observation (batch) or the query progress (stream)."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def evaluate_when_complete(
    expected: DataFrame,
    read_outputs: Callable[[], dict[str, tuple[DataFrame, str]]],
    evaluate: Callable[[], DataFrame],
    order: str = "seq",
) -> tuple[DataFrame, DataFrame | None]:
    """After an available-now run: the completeness report, and the evaluation if all is there (else None)."""
    report = completeness_report(expected, read_outputs(), order).persist()
    ok = overall_completeness(report).first().ok
    return report, (evaluate() if ok else None)
