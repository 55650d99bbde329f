"""Which methods of a running stream have answered every prompt.

Every (method, prompt) counts once, however often it comes; what is counted meets in a state
of two numbers per method, so neither a busy method nor a long run makes a state grow.
"""

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pairwright.functions.text import is_blank

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
RESULT = "method STRING, answered LONG, missing LONG, status STRING"


class Completion(StatefulProcessor):
    """Emits a method once when it is complete, and once as ``stalled`` if it is not ``patience_ms`` after its first answer."""

    def __init__(self, expected: int, patience_ms: int | None, keep_ms: int | None):
        self.expected, self.patience_ms, self.keep_ms = expected, patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a finished method is forgotten some time after its last row
        self.seen = handle.getValueState("seen", "n LONG, done BOOLEAN", self.keep_ms)

    def _row(self, key, n: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"method": [key[0]], "answered": [n], "missing": [self.expected - n], "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.get()
        n, done = known if known is not None else (0, False)
        if known is None and self.patience_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        n = int(n) + sum(int(part["n"].sum()) for part in rows)
        finished = not done and n >= self.expected
        self.seen.update((n, bool(done or finished)))
        if finished:
            yield self._row(key, n, "complete")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.seen.get()
        if known is not None and not known[1]:
            yield self._row(key, int(known[0]), "stalled")

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(method, n) of a task's rows."""
    total: Counter[str] = Counter()
    for batch in batches:
        total.update(batch["method"].to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["method", "n"])


def finished_methods(
    outputs: DataFrame, expected: DataFrame, answer: str = "final_answer", patience_ms: int | None = None, keep_ms: int | None = None
) -> DataFrame:
    """(``method``, ``answered``, ``missing``, ``status``) of a stream of outputs, each method once when it becomes complete.

    A method is complete when every ``prompt_id`` of ``expected`` (which is counted now) has
    an answer that is not blank.  Unexpected prompts, blank answers and rows without a
    method do not count, late and repeated rows count once; what comes for a finished method
    says nothing new.  ``patience_ms`` and ``keep_ms`` go by the clock, so a query with
    either runs on until it is stopped, also without new data.
    """
    clocked = patience_ms is not None or keep_ms is not None
    wanted = expected.select(F.col("prompt_id").cast("string").alias("prompt_id")).where("prompt_id IS NOT NULL").distinct()
    answered = outputs.where(~is_blank(F.col(answer)) & F.col("method").isNotNull()).select("method", F.col("prompt_id").cast("string").alias("prompt_id"))
    once = answered.join(wanted, "prompt_id", "left_semi").dropDuplicates(["method", "prompt_id"])
    return (
        once.mapInArrow(_counted, "method STRING, n LONG")
        .groupBy("method")
        .transformWithStateInPandas(Completion(wanted.count(), patience_ms, keep_ms), RESULT, "append", "processingTime" if clocked else "none")
    )


def write_finished(finished: DataFrame, path: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Append the finished methods to a parquet folder; by default processes what is there and stops.

    State with timers needs the RocksDB state store; it is set for this query's start only.
    """
    conf = finished.sparkSession.conf
    before = conf.get(PROVIDER)
    writer = finished.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start(path)
    finally:
        conf.set(PROVIDER, before)
