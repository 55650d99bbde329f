"""What is measured or shipped once."""

from pyspark.sql import functions as F

from pairwright.operators import selection
from pairwright.plans import evaluation
from tests.conftest import rows


def test_method_tables_read_written_numbers_not_persisted_ones(spark, capsys):
    outputs = spark.createDataFrame([("1", "raw", "a\na"), ("1", "sft", "b c")], "prompt_id STRING, method STRING, final_answer STRING")
    outputs = outputs.withColumns({"latency_ms": F.lit(1.0), "verifier_call_count": F.lit(1)})
    found = evaluation.method_metrics(outputs)
    found.explain()
    assert "InMemoryTableScan" not in capsys.readouterr().out
    assert [(r["method"], r["repeated_line_count_total"]) for r in rows(found, "method")] == [("raw", 1), ("sft", 0)]


def test_entries_of_the_empty_prefix_travel_as_the_roots_only(spark, monkeypatch):
    script = spark.createDataFrame(
        [("1", "", 0, "a", 0.0, False), ("1", "", 1, "b", 0.0, True), ("1", "a", 0, "c", 0.0, True), ("2", "", 0, "d", 0.0, True)],
        "prompt_id STRING, prefix STRING, ord INT, text STRING, logprob DOUBLE, is_complete BOOLEAN",
    )
    asked, entries = [], selection._entries
    monkeypatch.setattr(selection, "_entries", lambda s, keys, n: (asked.append((keys, {r.prefix for r in s.collect()})), entries(s, keys, n))[1])
    beams = spark.createDataFrame([("1", "p", ""), ("1", "p", "a"), ("1", "p", "x"), ("2", "q", "y"), ("3", "q", "")], "prompt_id STRING, prompt STRING, prefix STRING")
    found = selection.scripted_expander(script, by_prompt=True)(beams, 4)
    assert asked == [(["prompt_id", "prefix"], {"a"}), (["prompt_id"], {""})]
    assert [(r["prompt_id"], r["prefix"], r["cand_text"]) for r in rows(found, "prompt_id", "prefix", "cand_text")] == [
        ("1", "", "a"), ("1", "", "b"), ("1", "a", "c"), ("1", "x", "a"), ("1", "x", "b"), ("2", "y", "d"), ("3", "", None),
    ]
