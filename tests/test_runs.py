"""Requests, generation with resume and retries, answer rules, streams."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright import fixed_values as fixed
from pairwright.operators import answer_rules, requests, scoring, tables
from pairwright.plans.preference import generation_run
from pairwright.streaming import incremental
from tests.conftest import rows

PROMPT = "prompt_id STRING, prompt STRING, source STRING, metadata MAP<STRING,STRING>"
REQUEST = "prompt_id STRING, source_prompt STRING, generation_prompt STRING, model STRING, metadata MAP<STRING,STRING>"


def prompts(spark, n=1):
    return spark.createDataFrame([(f"p{i}", f"Explain topic {i}.", "taxonomy", {"topic": "memory"}) for i in range(n)], PROMPT)


def test_generation_requests(spark):
    (row,) = rows(requests.generation_requests(prompts(spark), "negative", "m"))
    assert row["generation_prompt"] == fixed.NEGATIVE_INSTRUCTIONS + "\n\nUser question:\nExplain topic 0.\n"
    assert row["metadata"] == {"topic": "memory", "source": "taxonomy", "generation_mode": "negative"}
    with pytest.raises(ValueError):
        requests.generation_requests(prompts(spark), "neutral", "m")


def test_judge_requests(spark):
    df = spark.createDataFrame([("p1", "ttc_beam", "Explain.", "Use memmove.")], "prompt_id STRING, method STRING, prompt STRING, final_answer STRING")
    (row,) = rows(requests.judge_requests(df, "remote-judge"))
    assert (row["request_id"], row["model"], row["metadata"]) == ("p1:ttc_beam", "remote-judge", {"method": "ttc_beam"})
    assert "academic_rigor, factual_density" in row["judge_prompt"] and "JSON" in row["judge_prompt"]
    assert row["judge_prompt"].endswith("User prompt:\nExplain.\n\nCandidate answer:\nUse memmove.\n")


def test_answer_precedence(spark):
    df = spark.createDataFrame([("final", "plain")], "final_answer STRING, answer STRING")
    row = df.select(requests.answer_of(df).alias("a"), requests.static_answer_of(df).alias("b")).first()
    assert (row.a, row.b) == ("final", "plain")
    assert tables.static_metrics(df.withColumn("method", F.lit("m"))).first().metrics.character_count == 5


def test_baseline_records(spark):
    df = spark.createDataFrame(
        [("p1", "q", "a", "m", -0.5, "stop", 2)],
        "prompt_id STRING, prompt STRING, text STRING, model STRING, logprob DOUBLE, finish_reason STRING, attempt INT",
    )
    (row,) = rows(requests.baseline_records(df, "raw", "run-1"))
    assert row["kind"] == "baseline" and row["metadata"] == {"generator_logprob": "-0.5", "finish_reason": "stop", "attempt": "2"}


def flaky_client(folder):
    """Fails the first call for p1, always fails for p2."""

    class Client:
        model = "flaky"

        def expand(self, prompt, prefix, count):
            mark = os.path.join(folder, "seen")
            if "bad" in prompt:
                raise RuntimeError("down")
            if "once" in prompt and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("try again")
            return [] if "nothing" in prompt else [(f"answer to {prompt}", -0.5, {"finish": "stop"})]

    return Client


def test_generation_resumes_retries_and_keeps_errors_as_rows(spark, tmp_path):
    df = spark.createDataFrame(
        [
            ("p0", "q0", "done before", "m", {"generation_mode": "positive"}),
            ("p1", "q1", "once", "m", {"generation_mode": "negative"}),
            ("p2", "q2", "bad", "m", {}),
            ("p3", "q3", "nothing", "m", None),
        ],
        REQUEST,
    )
    done = spark.createDataFrame([("p0",)], "prompt_id STRING")
    answers, errors = scoring.run_generation(df, flaky_client(str(tmp_path)), done, max_retries=2, partitions=1, sleep=lambda s: None)
    got = {r["prompt_id"]: r for r in rows(answers)}
    assert set(got) == {"p1", "p3"}
    assert (got["p1"]["kind"], got["p1"]["text"], got["p1"]["model"]) == ("rejected", "answer to once", "flaky")
    assert got["p1"]["metadata"]["generator_logprob"] == "-0.5" and got["p1"]["metadata"]["finish"] == "stop"
    assert (got["p3"]["kind"], got["p3"]["text"]) == ("chosen", "")
    assert "generator_logprob" not in got["p3"]["metadata"]
    assert [(r["prompt_id"], r["attempt"]) for r in rows(errors)] == [("p2", 3)]


def counting_client(folder, dies_after=None):
    class Client:
        model = "counting"

        def expand(self, prompt, prefix, count):
            calls = len(os.listdir(folder))
            if dies_after is not None and calls >= dies_after:
                os._exit(1)  # as a lost executor does
            open(os.path.join(folder, f"{calls}-{prompt}"), "w").close()
            return [(f"answer to {prompt}", None, {"call": calls})]

    return Client


def test_a_killed_generation_goes_on_where_it_stopped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    df = spark.createDataFrame([(f"p{i}", f"q{i}", f"ask {i}", "m", {}) for i in range(23)] + [("p0", "q0", "ask 0", "m", {})], REQUEST)
    settings = {"partitions": 1, "log": str(tmp_path / "log"), "chunk": 5}
    with pytest.raises(Exception):
        scoring.run_generation(df, counting_client(str(calls), dies_after=10), **settings)
    assert len(list(calls.iterdir())) == 10
    answers, errors = scoring.run_generation(df, counting_client(str(calls)), **settings)
    asked = [f.name.split("-")[1] for f in calls.iterdir()]
    assert len(asked) == len(set(asked)) == 23  # no request was paid twice
    assert answers.count() == 24 and errors.count() == 0  # a repeated request has its answer twice
    more, _ = scoring.run_generation(df.limit(3), counting_client(str(calls), dies_after=0), partitions=4, log=settings["log"])
    assert more.count() == 3


def test_a_task_that_runs_again_reads_the_log(tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    batches = [pd.DataFrame({"request": [f"r{i}" for i in range(7)], "generation_prompt": [f"ask {i}" for i in range(7)]})]
    run = scoring.answer_chunks(counting_client(str(calls)), scoring.ChunkLog(str(tmp_path)), 0, lambda s: None, 3)
    first = pd.concat(run(iter(batches)))
    again = pd.concat(run(iter(batches)))
    assert first["asked"].sum() == 7 and again["asked"].sum() == 0 and again["found"].sum() == 7
    assert len(list(calls.iterdir())) == 7 and len(list(tmp_path.glob("chunk-*"))) == 3 and not list(tmp_path.glob("_*"))


def test_generation_run(spark, tmp_path):
    def open_client(mode):
        class Client:
            model = mode

            def expand(self, prompt, prefix, count):
                return [(f"{mode} answer: {len(prompt)}" if mode == "positive" else ">>> no", 0.0, {})]

        return Client

    found = generation_run(prompts(spark, 10), open_client, str(tmp_path), "gen")
    assert found["report"].first().kept_pairs == 10
    assert sorted(r["n"] for r in rows(found["split"].groupBy("split").agg(F.count("*").alias("n")))) == [1, 1, 8]
    assert found["checks"].first().ok and found["errors"].count() == 0


GOOD = (
    "memcpy and memmove differ. Assumption: valid ranges. Limitation: short. Overlap is undefined behavior for memcpy. "
    + "More text. " * 120
)


def codes(spark, text, **columns):
    df = spark.createDataFrame([(text, columns.get("kind", "chosen"), columns.get("model", fixed.EXPECTED_ANSWER_MODEL))], "text STRING, kind STRING, model STRING")
    row = answer_rules.validate_answers(df).first()
    return sorted(row.failures), sorted(row.warnings)


@pytest.mark.parametrize(
    "extra, failures",
    [
        ("", []),
        ("```c", ["ends_mid_sentence", "unbalanced_code_fence"]),
        ("It is ill-formed.", ["runtime_called_ill_formed"]),
        ("memcpy copies as if a temporary array existed.", ["memcpy_temporary_guarantee"]),
        ("memcpy is fast. It acts as if through a temporary array.", ["memcpy_temporary_guarantee"]),
        ("memmove is safe. It acts as if through a temporary array.", []),
        ("memcpy is fast. memcpy and memmove differ. It uses a temporary array.", []),
        ("It goes backward (when dest < src). It is forward (when dest > src).", ["backward_when_dest_lower", "forward_when_dest_higher"]),
        ("memcpy goes backward (when dest < src).", []),
        ("dest < src needs backward.\ndest < src requires backward.", ["backward_when_dest_lower", "backward_when_dest_lower"]),
        ('char b[] = "abc"; x memcpy(p, b + 2, 1).', ["literal_array_write"]),
        ("memcpy(buf + 6, buf, 3).", ["out_of_bounds_copy"]),
        ("memmove(buf + 2, buf + 1, 3) gives abbcde.", ["shift_output_inconsistent"]),
    ],
)
def test_answer_rules(spark, extra, failures):
    assert codes(spark, GOOD + extra) == (failures, [])


def test_answer_rules_on_a_short_answer(spark):
    assert codes(spark, "no end", kind="rejected", model="other") == (
        ["ends_mid_sentence", "missing_required_term", "no_limitation_note", "too_short", "wrong_kind", "wrong_model"],
        ["no_assumption_note", "no_undefined_behavior_note"],
    )


def test_answer_stats(spark):
    df = spark.createDataFrame([("a", "xx"), ("a", "yyyy"), ("b", "z" * 5)], "prompt_id STRING, text STRING")
    assert answer_rules.answer_stats(df, 3).first().asDict() == {
        "rows": 3, "unique_ids": 2, "min_chars": 2, "avg_chars": 3, "max_chars": 5, "count_ok": True, "ids_unique": False,
    }
    assert answer_rules.answer_stats(df.limit(0)).first().rows == 0


def test_carried_subjects_of_long_texts(spark):
    """Every sentence of 20,000 once, and in linear time; null, empty and markless texts."""
    said = ["memcpy one.", "It goes on.", "Now memmove.", "And it.", "memcpy and memmove.", "Both."]
    wanted = ["memcpy", "memcpy", "memmove", "memmove", "", ""]
    data = [(1, " ".join(said * 3500)), (2, ""), (3, None), (4, "It. Is.")]
    df = spark.createDataFrame(data, "id INT, text STRING")
    started = time.perf_counter()
    got = rows(answer_rules.carried_subjects(df, "id", "text"), "id", "pos")
    assert time.perf_counter() - started < 20
    first = sorted((r for r in got if r["id"] == 1), key=lambda r: r["pos"])
    assert [r["pos"] for r in first] == list(range(21_000))
    assert [r["sentence"] for r in first] == said * 3500 and [r["subject"] for r in first] == wanted * 3500
    assert [(r["id"], r["pos"], r["sentence"], r["subject"]) for r in got if r["id"] > 1] == [
        (2, 0, "", ""), (4, 0, "It.", ""), (4, 1, "Is.", "")]


def test_carried_subjects(spark):
    df = spark.createDataFrame([(1, "Start. memcpy is fast. It copies. memmove and memcpy differ! So it is.\nmemmove wins.")], "id INT, text STRING")
    got = rows(answer_rules.carried_subjects(df, "id", "text"), "pos")
    assert [r["subject"] for r in got] == ["", "memcpy", "memcpy", "", "", "memmove"]


OUTPUT = "prompt_id STRING, method STRING, prompt STRING, final_answer STRING, latency_ms DOUBLE, verifier_call_count INT"


def land(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
        out.write("\n".join(json.dumps(r) for r in records) + "\n")


def test_streams_continue_where_they_ended(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [dict(prompt_id=f"p{i}", method="raw", prompt="q", final_answer="slogan >>> a", latency_ms=2.0, verifier_call_count=1) for i in range(3)]
    land(src, "a.json", first)

    def run():
        stream = incremental.stream_json(spark, src, OUTPUT, files_per_batch=1)
        scored = incremental.with_progress(scoring.score_outputs(stream, scoring.rule_scorer(["slogan"])), "scored")
        incremental.append_to(scored, f"{out}/scores", f"{out}/c1").awaitTermination()
        incremental.keep_latest(incremental.running_tables(stream), f"{out}/table", f"{out}/c2").awaitTermination()
        once = incremental.once_per_key(stream.select("prompt_id"))
        incremental.append_to(once, f"{out}/ids", f"{out}/c3").awaitTermination()

    run()
    assert spark.read.json(f"{out}/scores").count() == 3
    land(src, "b.json", [{**first[0], "final_answer": "clean", "latency_ms": None}, {**first[1], "method": "beam"}])
    run()
    scores = rows(spark.read.json(f"{out}/scores"), "prompt_id")
    assert len(scores) == 5 and [r["prompt_id"] for r in rows(spark.read.json(f"{out}/ids"), "prompt_id")] == ["p0", "p1", "p2"]
    batch = incremental.running_tables(spark.read.schema(OUTPUT).json(src))
    assert rows(incremental.read_latest(spark, f"{out}/table"), "method") == rows(batch, "method")
    assert rows(batch, "method")[1]["latency_ms_mean"] == 1.5


def test_deduplication_with_a_watermark(spark, tmp_path):
    src = f"{tmp_path}/in"
    land(src, "a.json", [{"prompt_id": "p", "at": "2024-01-01 00:00:00"}, {"prompt_id": "p", "at": "2024-01-01 00:00:05"}])
    stream = incremental.stream_json(spark, src, "prompt_id STRING, at TIMESTAMP")
    once = incremental.once_per_key(stream, event_time="at", delay="1 hour")
    incremental.append_to(once, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 1


def test_evaluation_waits_for_complete_outputs(spark):
    expected = spark.createDataFrame([("p1",), ("p2",)], "prompt_id STRING")
    full = spark.createDataFrame([("p1", "a", 0), ("p2", "b", 1)], "prompt_id STRING, text STRING, seq INT")
    report, found = incremental.evaluate_when_complete(expected, lambda: {"m": (full.limit(1), "text")}, lambda: full)
    assert found is None and report.first().missing_count == 1
    _, found = incremental.evaluate_when_complete(expected, lambda: {"m": (full, "text")}, lambda: full)
    assert found is full


def test_a_method_is_reported_once_and_may_stall():
    from pairwright.streaming import completion

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        timers: list[int] = []

        def getValueState(self, name, schema, ttl):
            self.state = State()
            return self.state

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    def rows(*counts):
        return iter([pd.DataFrame({"method": "m", "n": [n]}) for n in counts])

    processor, handle = completion.Completion(5, 60, None), Handle()
    processor.init(handle)
    status = lambda frames: [tuple(r) for f in frames for r in f.itertuples(index=False)]
    assert status(processor.handleInputRows(("m",), rows(2, 1), Clock())) == []
    assert handle.timers == [1060]
    assert status(processor.handleExpiredTimer(("m",), Clock(), None)) == [("m", 3, 2, "stalled")]
    assert status(processor.handleInputRows(("m",), rows(2), Clock())) == [("m", 5, 0, "complete")]
    assert status(processor.handleInputRows(("m",), rows(1), Clock())) == [] and handle.timers == [1060]
    assert status(processor.handleExpiredTimer(("m",), Clock(), None)) == []
