"""Answer scoring and generation through plug-ins.

A *scorer* is any function ``(prompt column, answer column) -> double column``.
:func:`rule_scorer` stays in the JVM; :func:`client_scorer` wraps an object with
``score(prompt, answer)`` in an Arrow UDF that opens one client per task.
"""

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from pairwright.functions.text import word_count, heading_count
from pairwright.functions.values import pearson, rule_reward
from pairwright.operators.joins import pending
from pairwright.operators.quantiles import stats_with_median
from pairwright.operators.requests import answer_of, answer_records, column_or
from pairwright.session import fresh_dir, landed

Scorer = Callable[[Column, Column], Column]
CHUNK = 100  # calls whose answers are written together


def rule_scorer(rewards: list[str] = (), penalties: list[str] = ()) -> Scorer:
    return lambda prompt, answer: rule_reward(answer, list(rewards), list(penalties))


def client_scorer(open_client: Callable[[], object]) -> Scorer:
    # a null answer is not sent to the client
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        client = open_client()
        for prompts, answers in batches:
            yield pd.Series(
                [None if a is None else float(client.score(p, a)) for p, a in zip(prompts, answers)], dtype="float64"
            )

    return lambda prompt, answer: score(prompt, answer)


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    return pairs.withColumns(
        {
            "chosen_score": scorer(F.col("prompt"), F.col("chosen")),
            "rejected_score": scorer(F.col("prompt"), F.col("rejected")),
        }
    )


def score_outputs(outputs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score rows of merged method outputs; ``keep`` names further columns of theirs."""
    return outputs.select(
        "prompt_id",
        "method",
        scorer(column_or(outputs, "prompt", ""), answer_of(outputs)).alias("score"),
        column_or(outputs, "source_run_id", "").alias("source_run_id"),
        *keep,
    )


def margins(scored: DataFrame) -> DataFrame:
    """Score, word and heading differences of scored pairs."""
    chosen, rejected = F.coalesce(F.col("chosen"), F.lit("")), F.coalesce(F.col("rejected"), F.lit(""))
    return scored.select(
        "prompt_id",
        F.col("chosen_score").cast("double").alias("chosen_score"),
        F.col("rejected_score").cast("double").alias("rejected_score"),
        (F.col("chosen_score").cast("double") - F.col("rejected_score").cast("double")).alias("margin"),
        (word_count(chosen) - word_count(rejected)).cast("double").alias("words_delta"),
        (heading_count(chosen) - heading_count(rejected)).cast("double").alias("headings_delta"),
    )


def validate_scores(scored: DataFrame, min_accuracy: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """One-row report on how well the scores separate chosen from rejected, and the failing pairs."""
    deltas = landed(margins(scored), "margins")  # a few numbers per pair, read more than once
    margin = F.col("margin")
    report = stats_with_median(
        deltas,
        [],
        [
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.avg((margin > 0).cast("double")), F.lit(0.0)).alias("pairwise_accuracy"),
            F.coalesce(F.avg(margin), F.lit(0.0)).alias("mean_margin"),
            F.min(margin).alias("min_margin"),
            F.max(margin).alias("max_margin"),
            pearson(F.col("words_delta"), margin).alias("length_score_correlation"),
            pearson(F.col("headings_delta"), margin).alias("markdown_score_correlation"),
            F.count_if(margin <= 0).alias("failure_count"),
        ],
        "margin",
        "median_margin",
    )
    report = report.withColumns(
        {
            "median_margin": F.coalesce("median_margin", F.lit(0.0)),
            "passed_min_accuracy": (F.col("count") > 0) & (F.col("pairwise_accuracy") >= F.lit(float(min_accuracy))),
        }
    )
    failures = deltas.where(margin <= 0).select("prompt_id", "chosen_score", "rejected_score", "margin")
    return report, failures


RESPONSE = "request STRING, text STRING, logprob DOUBLE, response_metadata MAP<STRING,STRING>, generator_model STRING, attempt INT, latency_ms DOUBLE, error STRING"


def _request_hash() -> Column:
    """Names a request: equal ones are asked once."""
    metadata = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    return F.sha2(F.to_json(F.struct("prompt_id", "generation_prompt", "model", metadata.alias("metadata"))), 256)


def ask(client, prompt: str, max_retries: int, sleep: Callable[[float], None]) -> dict:
    """One answer of the client, or the error of its last attempt; the time is that of all attempts without the waits."""
    spent = 0.0
    for attempt in range(1, max_retries + 2):
        started = time.perf_counter()
        try:
            found, error = client.expand(prompt, "", 1), None
        except Exception as failure:  # noqa: BLE001 - any client error is a row, not a job failure
            found, error = None, repr(failure)
        spent += 1000 * (time.perf_counter() - started)
        if error is None or attempt > max_retries:
            break
        sleep(min(2**attempt, 30))
    text, logprob, metadata = found[0] if found else (None, None, {})
    return {
        "text": text, "logprob": None if logprob is None else float(logprob), "response_metadata": {k: None if v is None else str(v) for k, v in dict(metadata).items()},
        "generator_model": getattr(client, "model", None), "attempt": attempt, "latency_ms": spent, "error": error,
    }


class ChunkLog:
    """Responses in a folder that all executors share, a file per chunk, named by the chunk's requests.

    A file appears whole or not at all, and a chunk with the same requests has the same name:
    whoever asks a chunk again, a restarted task or a speculative one, finds what was paid for.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _place(self, requests: list[str]) -> tuple[fs.FileSystem, str]:
        system, folder = fs.FileSystem.from_uri(self.folder)
        return system, f"{folder.rstrip('/')}/chunk-{hashlib.sha256(','.join(requests).encode()).hexdigest()}.parquet"

    def read(self, requests: list[str]) -> bool:
        """Whether the chunk is there."""
        system, path = self._place(requests)
        return system.get_file_info(path).is_file

    def write(self, requests: list[str], answers: list[dict]) -> None:
        system, path = self._place(requests)
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/_{name}.{uuid.uuid4().hex}"  # readers of the folder pass over names that begin so
        rows = [{"request": r, **a, "response_metadata": list(a["response_metadata"].items())} for r, a in zip(requests, answers, strict=True)]
        with system.open_output_stream(draft) as out:
            pq.write_table(pa.Table.from_pylist(rows, _RESPONSE), out)
        system.move(draft, path)


_RESPONSE = pa.schema(
    [("request", pa.string()), ("text", pa.string()), ("logprob", pa.float64()), ("response_metadata", pa.map_(pa.string(), pa.string())),
     ("generator_model", pa.string()), ("attempt", pa.int32()), ("latency_ms", pa.float64()), ("error", pa.string())]
)


def answer_chunks(open_client: Callable[[], object], log: ChunkLog, max_retries: int, sleep: Callable[[float], None], chunk: int = CHUNK):
    """Ask for the (request, generation_prompt) rows that the log lacks, chunk by chunk; yields how many were asked and found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in (b.iloc[at : at + chunk] for b in batches for at in range(0, len(b), chunk)):
            requests = batch["request"].tolist()
            known = log.read(requests)
            if not known:
                client = client or open_client()
                log.write(requests, [ask(client, p, max_retries, sleep) for p in batch["generation_prompt"]])
            yield pd.DataFrame({"asked": [0 if known else len(batch)], "found": [len(batch) if known else 0]})

    return run


def responses_of(requests: DataFrame, open_client: Callable[[], object], log: str, max_retries: int = 3, partitions: int | None = None, sleep: Callable[[float], None] = time.sleep, chunk: int = CHUNK) -> DataFrame:
    """Every request row with its response (``RESPONSE``) from the log, which is filled first.

    Requests that the log answers already are not asked, whichever run asked them; errors
    are answers too.  The rest is dealt out and ordered by request, so that a task that runs
    again forms the same chunks and asks only from its first missing one on: at most one
    chunk of ``chunk`` calls a task is paid twice, the one that was open when the task died.
    """
    spark = requests.sparkSession
    named = requests.withColumn("request", _request_hash())
    system, folder = fs.FileSystem.from_uri(log)
    system.create_dir(folder)
    todo = named.select("request", "generation_prompt").distinct()
    if any(f.base_name.startswith("chunk-") for f in system.get_file_info(fs.FileSelector(folder))):
        todo = todo.join(spark.read.schema(RESPONSE).parquet(log).select("request"), "request", "left_anti")
    dealt = (todo.repartition(partitions, "request") if partitions else todo.repartition("request")).sortWithinPartitions("request")
    dealt.mapInPandas(answer_chunks(open_client, ChunkLog(log), max_retries, sleep, chunk), "asked LONG, found LONG").write.format("noop").mode("overwrite").save()
    return named.join(spark.read.schema(RESPONSE).parquet(log), "request")


def run_generation(
    requests: DataFrame,
    open_client: Callable[[], object],
    done: DataFrame | None = None,
    max_retries: int = 3,
    partitions: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    log: str | None = None,
    chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Generate one answer per request that ``done`` does not hold yet.

    The client has ``expand(prompt, prefix, count)`` returning (text, logprob, metadata)
    tuples.  A call is tried ``max_retries + 1`` times with growing waits; a request that
    still fails becomes an error row instead of failing the job.  Responses go chunk by chunk
    to the folder ``log`` (one of its own below the shared folder if not given): a restarted
    task, or a run with the same log, goes on where the last one stopped.  Answers and errors
    are two readings of that log.
    """
    todo = requests if done is None else pending(requests, done)
    todo = todo.select("prompt_id", "source_prompt", "generation_prompt", "model", "metadata")
    responses = responses_of(todo, open_client, log or fresh_dir(requests.sparkSession, "responses"), max_retries, partitions, sleep, chunk)
    answers = answer_records(responses.where(F.col("error").isNull()))
    errors = responses.where(F.col("error").isNotNull()).select("prompt_id", "attempt", "error")
    return answers, errors
